"""Work that must grow no faster than the tables: the findings of round 3 at size."""

import base64
import datetime as dt
import random
from collections import Counter
from urllib.parse import quote

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioloom.functions import codes, text
from folioloom.operators import audit, catalog, formatting, manuscripts, publish, segment
from folioloom.operators import events as ev
from folioloom.plans import stand_ins, store_queries
from folioloom.sources import paged
from folioloom.streaming import events as stream
from folioloom.streaming import readers


def analyzed(rows):
    return rows._jdf.queryExecution().analyzed().toString()


def test_keys_of_plain_lines_are_made_for_contents_lists_alone(spark):
    """A short unmarked line has no key beforehand, and is found in a contents list all the same."""
    rows = spark.createDataFrame([("# A Head\nSalt Road\nmore",)], "text string")
    assert rows.select(F.transform(segment.lines_of(F.col("text")), lambda x: x["key"]).alias("k")).first().k == ["a head", None, None]
    prose = "many words of prose " * 20
    body = f"# Book\n## Contents\nSalt Road\nLow Weir\n# Book\nSalt Road\n{prose}\nLow Weir\n{prose}"
    found = segment.sections(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    assert [(r.title, r.kind) for r in found] == [("Salt Road", "listed"), ("Low Weir", "listed")]
    assert all(r.words == len(r.content.split()) for r in found)


def test_phrases_are_counted_without_their_strings(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice("abcd"[:n]) for _ in range(size)) for size in (0, 1, 2, 11, 12, 13, 60) for n in (1, 2, 4)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "# The É-word, the e word", *texts])], "doc_id long, text string")
    strings = rows.select("doc_id", F.size(text.ngrams(text.words(text.normalized_heading(F.col("text"))))).alias("n"))
    counted = formatting.phrase_counts(rows)
    assert {r.doc_id: r.phrases for r in counted.collect()} == {r.doc_id: r.n for r in strings.collect()}
    assert "array_distinct" not in analyzed(counted)


def test_a_request_is_parsed_once(spark):
    """One strict parse, of three passes; fields come from its value."""
    bodies = ['{"eventType":"book_view","bookId":"12121212-3434-4565-8787-000000000001","anonymousId":"12121212-3434-4565-8787-000000000001"}', "[1]", "7", "null", "{", '{"eventType":7}', None, " " * 5000]
    found = ev.request_outcomes(spark.createDataFrame([(b, None) for b in bodies], "body string, user_id string"))
    assert analyzed(found).count("parse_json") <= 3
    assert [r.outcome for r in found.collect()] == [None, "invalid event", "invalid event", "invalid event", "not JSON", "invalid event", "not JSON", "too large"]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(400).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = stand_ins.dealt(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert len({r.p for r in rows.select(F.spark_partition_id().alias("p")).collect()}) == 4
    assert sorted(r.id for r in rows.collect()) == list(range(400))


def test_pages_of_a_row_group_are_read_in_one_stream(spark, tmp_path, monkeypatch):
    """300 pages of 10 rows in row groups of 700: 96 partitions at most, each of which opens a row group once."""
    path = f"{tmp_path}/t.parquet"
    pq.write_table(spark.range(2995).selectExpr("id", "id * 2 AS twice").toArrow(), path, row_group_size=700)
    found = paged.scan(spark, "id", path=path, pageRows=10, pageColumn="page")
    assert sorted(map(tuple, found.collect())) == [(k, 2 * k, k // 10) for k in range(2995)]
    reader = paged.PageReader({"path": path, "pagerows": "10"}, paged.ParquetPages(path).schema())
    parts = reader.partitions()
    assert len(parts) <= paged.PARTITIONS
    opened = []
    whole = pq.ParquetFile.iter_batches
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", lambda self, *a, **k: opened.append(k["row_groups"]) or whole(self, *a, **k))
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == list(range(2995))
    assert len(opened) <= len(parts) + 4


def test_a_run_of_pages_tells_that_the_table_changed(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    pq.write_table(spark.range(2995).toArrow(), path)
    reader = paged.PageReader({"path": path, "pagerows": "10"}, paged.ParquetPages(path).schema())
    last = reader.partitions()[-1]
    for rows in (2996, 2994, 2940):
        pq.write_table(spark.range(rows).toArrow(), path)
        try:
            list(reader.read(last))
        except ValueError as error:
            assert "changed" in str(error)
        else:
            raise AssertionError(rows)


def test_masks_of_all_keys(spark):
    """Against the bytes, the keys that make a byte 0 and those over 127 among them; nothing is done sign by sign."""
    told = "Az09-_.!~*'() é\U0001f600+%/\n"
    rows = spark.range(255).select(F.col("id").alias("k"), F.lit(told).alias("t")).select("k", codes.masked(F.col("t"), F.col("k")).alias("m"))
    rows = rows.withColumn("back", codes.unmasked(F.col("m"), F.col("k")))
    encoded = quote(told, safe="-_.!~*'()").encode()
    assert all(r.m == base64.b64encode(bytes(b ^ r.k for b in encoded)).decode() and r.back == told for r in rows.collect())
    assert "lambda" not in analyzed(rows)


def test_only_counts_of_characters_meet(spark):
    left = ["abca", " a\u3000b\ufeff", "11 2", "112", "12", "", None, "é\U0001f600", "aab", "x", None]
    right = ["caab", "ba", "1 12", "122", "21", " \n", None, "\U0001f600é", "abb", None, ""]
    frame = lambda texts: spark.createDataFrame([*enumerate(texts)], "k long, t string")
    found = audit.same_characters(frame(left), frame(right), "k", "t")
    strip = lambda t: t and Counter(c for c in t if c not in text.JSWS_CHARACTERS)
    same = [(a is None) == (b is None) and (strip(a) or Counter()) == (strip(b) or Counter()) for a, b in zip(left, right, strict=True)]
    assert [r.same for r in found.orderBy("k").collect()] == same
    assert "array_sort" not in analyzed(found)


def test_contiguity_stays_in_a_set_number_of_parts(spark):
    """Small shuffled rows are put together into few tasks, whose counts then grow with the table."""
    rows = spark.createDataFrame([(k, n) for k in range(40) for n in range(1, 4 + (k % 4 == 0)) if (k % 5, n) != (0, 2)] + [(1, 3)], "k long, n int")
    found = catalog.contiguity(rows, "k", "n")
    assert {r.k: (r.n, r.contiguous) for r in found.collect()} == {k: (3 + (k % 4 == 0) - (k % 5 == 0) + (k == 1), k % 5 != 0 and k != 1) for k in range(40)}
    assert found.rdd.getNumPartitions() == 4


def test_a_manifest_is_parsed_once(spark):
    url = lambda n: f"https://example.org/read/b/{n}"
    listed = ", ".join(f'{{"number":{n},"title":"{t}","url":"{url(u)}"}}' for n, t, u in ((3, "c", 3), (1, "b", 1), (1, "a", 1), (2, "x", 9), (0, "z", 0), (2, "d", 2)))
    rows = spark.createDataFrame([(1, f'{{"schemaVersion":1,"book":{{"slug":"b","totalChapters":3}},"chapters":[{listed}]}}'), (2, '{"schemaVersion":2}'), (3, '{"schemaVersion":1}')], "book_id long, manifest string")
    found = publish.read_manifest(rows)
    assert [(r.book_id, r.chapters and [(c.number, c.title) for c in r.chapters], r.complete) for r in found.collect()] == [(1, [(1, "a"), (2, "d"), (3, "c")], True), (3, [], False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1 and "array_position" not in plan


def test_plain_texts_are_cut_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "Chapter 1: A\nx\nsection 2\n\nChapter 3\ny"), (2, "no heading\n\nat all"), (3, ""), (4, None), (5, "Chapter 9\n")], "doc_id long, text string")
    found = manuscripts.plain_chapters(rows, fallback_characters=5)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "A", "x"), (1, 3, "Chapter 3", "y"), (2, 1, "Section 1", "no heading"), (2, 2, "Section 2", "at all"), (3, 1, "Full Story", ""), (4, 1, "Full Story", "")]
    assert "Union" not in analyzed(found)


def test_tags_are_collapsed_once(spark):
    rows = spark.createDataFrame([(["A  b", " a B", "", " ", "c", "C", None],), ([],), (None,)], "t array<string>").select(text.normalize_tags(F.col("t")).alias("t"))
    assert [r.t for r in rows.collect()] == [["A b", "c"], [], None]
    assert analyzed(rows).count("btrim") == 1


@pytest.mark.parametrize("groups", [1, 3])
def test_readers_share_groups_of_state(spark, tmp_path, groups):
    """40 readers in few keys of the state store, in three batches, with late events: as the batch twin."""
    draw, start = random.Random(groups), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=900 * (k // 200) + draw.randrange(900)), f"{draw.randrange(40)}", None, "book_view", 1, 1, 1) for k in range(600)]
    late = [(k, start, f"{k % 40}", None, "book_view", 1, 1, 1) for k in range(900, 905)]
    last = [(1000, start + dt.timedelta(days=3), "last", None, "book_view", 1, 1, 1)]
    folder, updated = f"{tmp_path}/in", []
    for part in (rows[:200], rows[200:400], rows[400:] + late + last):
        spark.createDataFrame(part, stream.EVENT_SCHEMA).write.mode("append").parquet(folder)
        verdicts = readers.timed(spark.readStream.schema(stream.EVENT_SCHEMA).parquet(folder), ev.reader_key(), readers.Admission(1, 60), lateness="1 second", groups=groups)
        started = readers.write_verdicts(verdicts, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        started.awaitTermination()
        updated += [s["numRowsUpdated"] for p in started.recentProgress for s in p["stateOperators"]]
    expected = {r.event_id: r.accepted for r in ev.admit(spark.createDataFrame(rows, stream.EVENT_SCHEMA), 1, 60).collect()}
    found = spark.read.parquet(f"{tmp_path}/out/verdicts").where("event_id < 900").collect()
    assert {r.event_id: r.verdict == "accepted" for r in found} == expected and len(found) == len(rows) and 0 < sum(expected.values()) < len(rows)
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/out/late").collect()} == {r[0] for r in late}
    assert max(updated) <= 5 * groups


def test_parts_of_a_stream_are_written_by_all_tasks(spark, tmp_path):
    """Each part of a table of three files is three files, not one task's."""
    spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k % 100), k, "view", 1.0, "{}") for k in range(300)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    for _ in store_queries.arrivals(spark, str(tmp_path), f"{tmp_path}/in", 2):
        rows = spark.read.parquet(f"{tmp_path}/in")
        seen.append((rows.where("event_id >= 0").count(), rows.count(), len(rows.inputFiles())))
    assert [s[:2] for s in seen] == [(150, 150), (300, 301)] and seen[0][2] == 3


def test_a_line_is_read_to_its_ninth_token(spark):
    """Long lines are those of nine tokens or more, hyphens and apostrophes within and beside words too."""
    draw = random.Random(22)
    rows = spark.createDataFrame([("".join(draw.choice("ab  '-’é1_ .—") for _ in range(draw.randint(0, 70))),) for _ in range(3000)] + [("a-" * 30,), ("a" * 5000,), ("",)], "t string")
    found = rows.select("t", text.token_count(F.col("t")).alias("n"), F.col("t").rlike(text.LONG_LINE).alias("long")).collect()
    assert [r for r in found if r.long != (r.n >= 9)] == [] and 500 < sum(r.long for r in found) < 2500


def test_a_block_is_trimmed_once(spark):
    nine = "one two three four five six seven eight nine"
    texts = {" * * * \n": "scene_break", "\n# Head ": "heading", "Chapter 1\n": "heading", "Dear Ann,\nyes": "letter", "- a\nb": "list", "a b\n\n c \n": "poetry", f"a\n{nine}": "prose", "\n".join("abcd") + f"\n{nine}": "poetry", " one line\n": "prose", "": "prose"}
    rows = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string").select("t", text.block_kind(F.col("t")).alias("kind"))
    assert {r.t: r.kind for r in rows.collect()} == {**texts, None: "prose"}
    assert analyzed(rows).count("btrim") == 2  # the text and its lines
    parts = spark.createDataFrame([("# A\n\n  b c \n***",)], "t string").select(text.blocks(F.col("t"), "\n").alias("b"))
    assert [tuple(b) for b in parts.first().b] == [("heading", "# A"), ("prose", "b c"), ("scene_break", "***")]
    assert analyzed(parts).count("btrim") == 2


def test_editions_meet_as_books_and_no_page_is_shuffled(spark):
    books = spark.createDataFrame([(1, "a b", "en", None), (2, "two", "sw", 1), (3, "a b-sw", "sw", None), (4, "none", "en", None)], "id long, slug string, language_code string, parent_book_id long")
    chapters = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (9, 1)], "book_id long, chapter_number int")
    links = publish.alternates(books, chapters)
    at = lambda slug, n: f"{publish.SITE}/read/{slug}/{n}"
    a, sw = "a%20b", "a%20b-sw"
    expected = {
        (1, 1): [("en", at(a, 1)), ("sw", at(sw, 1)), ("x-default", at(a, 1))],
        (1, 2): [("en", at(a, 2)), ("sw", at("two", 2)), ("x-default", at(a, 2))],
        (2, 2): [("en", at(a, 2)), ("sw", at("two", 2)), ("x-default", at(a, 2))],
        (3, 1): [("en", at(a, 1)), ("sw", at(sw, 1)), ("x-default", at(a, 1))],
    }
    assert sorted(map(tuple, links.collect())) == sorted((*page, *link) for page, all_ in expected.items() for link in all_)
    own = books.select("id", "slug")
    marked = links.join(own, "id").withColumn("_self", F.col("url") == publish.chapter_url(F.col("slug"), F.col("chapter_number")))
    elements = publish.page_elements(publish.page_links(books, chapters), "2000-01-01")
    assert sorted(map(tuple, elements.collect())) == sorted(map(tuple, publish.sitemap_entries(marked, "2000-01-01").collect()))
    plan = elements._jdf.queryExecution().optimizedPlan().toString()
    assert "chapter_number" not in "".join(line for line in plan.splitlines() if "Join" in line)
