"""What is kept survives failures: ledgers, keyed files, monthly reports, site maps at their limits, matches by key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioloom.functions import codes, text
from folioloom.operators import audit, formatting, publish
from folioloom.sources import files, keyed
from folioloom.streaming import events as stream
from folioloom.streaming import ledger, reports


# --- ledger


def pieces(spark, folder, parts):
    for k in range(parts):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stopped_run_goes_on(spark, tmp_path):
    read = pieces(spark, f"{tmp_path}/in", 3)
    book = ledger.Ledger(spark, f"{tmp_path}/ledger", ["id"], "id long, twice long")
    seen = []

    def work(batch):
        seen.append(sorted(r.id for r in batch.collect()))
        if len(seen) == 2:
            raise RuntimeError("stopped midway")
        return batch.select("id", (F.col("id") * 2).alias("twice"))

    with pytest.raises(Exception, match="stopped midway"):
        book.run(read(), f"{tmp_path}/c", work).awaitTermination()
    assert book.finished().count() == 10
    book.run(read(), f"{tmp_path}/c", work).awaitTermination()
    assert sorted((r.id, r.twice) for r in book.finished().collect()) == [(k, 2 * k) for k in range(30)]
    book.run(read(), f"{tmp_path}/without-checkpoint", work).awaitTermination()
    assert book.finished().count() == 30 and seen[4:] == [[], [], []]


def test_failed_pieces_are_tried_again(spark, tmp_path):
    read = pieces(spark, f"{tmp_path}/in", 1)
    book = ledger.Ledger(spark, f"{tmp_path}/ledger", ["id"], "id long, twice long")
    bad = lambda which: lambda b: b.select("id", (F.col("id") * 2).alias("twice"), F.when(which, "HTTP 503").alias("error"))
    book.run(read(), f"{tmp_path}/c1", bad(F.col("id") > 6)).awaitTermination()
    assert tuple(book.totals().first()) == (7, 3, 10)
    assert sorted(r.id for r in book.failed().collect()) == [7, 8, 9]
    book.run(read(), f"{tmp_path}/c2", bad(F.col("id") > 8)).awaitTermination()
    assert tuple(book.totals().first()) == (9, 1, 13)


def test_a_repeated_batch_replaces_its_part(spark, tmp_path):
    book = ledger.Ledger(spark, f"{tmp_path}/ledger", ["id"], "id long")
    for _ in range(2):
        book.work(spark.range(5), "query-0", lambda b: b)
    assert book.finished().count() == 5 == book.entries().count()


def test_tails(spark):
    rows = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "gh"), (1, 3, ""), (2, 1, "x"), (1, 4, "end")], "doc_id long, chunk long, text string")
    found = {(r.doc_id, r.chunk): r.tail for r in formatting.with_tails(rows, characters=3).collect()}
    assert found == {(1, 1): None, (1, 2): "def", (1, 3): "gh", (1, 4): "", (2, 1): None}


# --- files by key


def test_keyed_files_are_published_at_once(spark, tmp_path):
    folder = f"{tmp_path}/pages"
    rows = spark.range(20).select(F.concat(F.lit("book-"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("é"), F.col("id").cast("int") + 1).alias("content")).repartition(4)
    state = keyed.publish(rows, folder)
    assert (state["files"], state["bytes"]) == (20, 2 * sum(range(21)))
    expected = {(f"book-{k % 3}/{k}", 2 * k + 2) for k in range(20)}
    assert {(r.path, r.bytes) for r in keyed.published(spark, folder).collect()} == expected
    assert files.listing(spark, f"{folder}/data").count() == 20
    broken = rows.withColumn("content", F.when(F.col("path") == "book-1/19", F.raise_error(F.lit("no page"))).otherwise(F.col("content")).cast("string"))
    with pytest.raises(Exception, match="no page"):
        keyed.publish(broken, folder)
    assert keyed.current(folder) == state and files.listing(spark, f"{folder}/data").count() == 20
    keyed.publish(rows.limit(2), folder)
    assert keyed.published(spark, folder).count() == 2
    assert keyed.publish(rows.limit(0), folder)["files"] == 0 and keyed.published(spark, folder).count() == 0


@pytest.mark.parametrize("path", ["../up", "/top", "a//b", "", "a/./b", None])
def test_paths_stay_below_the_folder(spark, tmp_path, path):
    with pytest.raises(Exception, match="no place below"):
        keyed.publish(spark.createDataFrame([(path, "x")], "path string, content string"), f"{tmp_path}/pages")
    assert keyed.current(f"{tmp_path}/pages") is None


def test_repeated_paths_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="repeats"):
        keyed.publish(spark.createDataFrame([("a", "x"), ("a", "y")], "path string, content string"), f"{tmp_path}/pages")


# --- monthly reports


def event(k, day, month=1):
    return (k, dt.datetime(2024, month, day), "u", None, "book_view", 1, 1, 5)


def test_reports_survive_the_driver(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(list(rows), stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    ingest = lambda: reports.MonthlyReports(spark, f"file://{tmp_path}/book").ingest(stream.source(spark, folder), f"{tmp_path}/c").awaitTermination()
    book = lambda: reports.MonthlyReports(spark, f"file://{tmp_path}/book")  # noqa: E731 a new object each time: only the tables remember
    put(event(1, 5), event(2, 6), event(3, 2, 2))
    ingest()
    with pytest.raises(RuntimeError, match="mail"):
        book().close("2024-01-01", "2024-02-01", lambda rollups: (_ for _ in ()).throw(RuntimeError("mail")))
    assert [(r.status, r.error) for r in book().runs().collect()] == [("failed", "mail")]
    with pytest.raises(ValueError):
        book().purge("2024-01-01", "2024-02-01")
    put(event(4, 7))
    ingest()
    seen = []
    for _ in range(2):
        assert book().close("2024-01-01", "2024-02-01", lambda rollups: seen.append(rollups.first()["event_count"])) == "sent"
    assert seen == [3]
    put(event(5, 8), event(6, 9, 2), event(7, 1, 3))
    ingest()
    assert sorted(map(tuple, book().summary().collect())) == [(dt.date(2024, 1, 1), "sent", 3, 1, 3), (dt.date(2024, 2, 1), "open", 0, 0, 2), (dt.date(2024, 3, 1), "open", 0, 0, 1)]
    kept, gone = book().purge("2024-01-01", "2024-02-01")
    assert gone == 3 and kept.count() == 3


# --- site maps


@pytest.mark.parametrize(("urls", "size"), [(7, 10_000), (1000, 300), (5, 200), (1, 10_000)])
def test_site_maps_keep_their_limits(spark, urls, size):
    rng = random.Random(urls)
    rows = [(rng.choice("ab"), f"https://x/{k:04d}", "e" * rng.randint(1, 150), "2024-01-01") for k in range(300)]
    split = publish.split_sitemap(spark.createDataFrame(rows, "sitemap string, url string, element string, lastmod string").repartition(3), urls, size).collect()
    assert sorted((r.sitemap, r.url, r.element) for r in split) == sorted(r[:3] for r in rows)
    children = {}
    for r in split:
        children.setdefault((r.sitemap, r.child), []).append((r.url, len(r.element) + 1))
    assert all(len(own) <= urls and sum(n for _, n in own) <= size for own in children.values())
    for name in "ab":
        own = [children[key] for key in sorted(k for k in children if k[0] == name)]
        assert sorted(k[1] for k in children if k[0] == name) == list(range(1, len(own) + 1))
        assert all(max(x)[0] < min(y)[0] for x, y in zip(own, own[1:], strict=False))


def test_too_large_an_element(spark):
    with pytest.raises(ValueError, match="an element has 101 bytes"):
        publish.split_sitemap(spark.createDataFrame([("a", "u", "e" * 100)], "sitemap string, url string, element string"), 10, 100)
    empty = spark.createDataFrame([], "sitemap string, url string, element string, lastmod string")
    assert publish.sitemap_children(publish.split_sitemap(empty)).collect() == []


# --- matches


def test_matches_by_key(spark):
    rng = random.Random(2)
    made = lambda n: "".join(rng.choice("ab_") for _ in range(n))
    ids = sorted({f"2024-01-0{rng.randint(1, 9)}_{made(rng.randint(1, 5))}" for _ in range(12)} | {"nothing", "2024-01-02_aabbaabbaab", "2024-01-09_b"})
    slugs = sorted({made(rng.randint(1, 9)).replace("_", "-") for _ in range(150)} | {"ab", "b", "x-aabbaabbaab-y", "2024-01-09_b", "zzz", "g"})

    def brute(slug):
        for own in ids:
            name = own.partition("_")[2] if "_" in own else None
            if own.endswith(slug) or (name and name in slug.replace("-", "_")):
                return own

    found = audit.match_ids(spark.createDataFrame([(s,) for s in [*slugs, ""]], "slug string"), spark.createDataFrame([(i,) for i in [*ids, None]], "book_id string")).collect()
    nameless = [i for i in ids if "_" not in i]
    expected = {s: min([x for x in [brute(s), *nameless] if x]) for s in slugs} | {"": None}
    assert {r.slug: r.book_id for r in found} == expected
    without = audit.match_ids(spark.createDataFrame([("zzz",)], "slug string"), spark.createDataFrame([("2024-01-01_a",)], "book_id string"))
    assert without.first()["book_id"] is None  # never the first id for want of another


def test_tags_out_of_texts(spark):
    rows = [(" a, B ,,a,  c  d", ["a", "B", "c d"]), ('["x", "X", 3, null, " y "]', ["x", "y"]), ("[broken, z", ["[broken", "z"]), (None, []), ("", []), ('{"a": 1}', ['{"a": 1}'])]
    found = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", text.normalize_tags(text.tag_list(F.col("t"))).alias("tags")).collect()
    assert {r.k: r.tags for r in found} == {k: tags for k, (_, tags) in enumerate(rows)}


def test_sealed_texts(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    rows = spark.createDataFrame([("a",), ("",), (None,), ("é" * 1000,)], "t string")
    out = rows.select("t", codes.opened(codes.sealed(F.col("t"), key, F.lit("b")), key, F.lit("b")).alias("same"), codes.opened(codes.sealed(F.col("t"), key, F.lit("b")), F.lit("0123456789abcdeX").cast("binary"), F.lit("b")).alias("other")).collect()
    assert all(r.same == r.t and r.other is None for r in out)
