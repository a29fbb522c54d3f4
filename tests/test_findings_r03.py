"""What the third round of findings was about."""

import datetime as dt
import re
import time
from collections import deque

import pytest
from py4j import clientserver
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import audit, formatting, ingest, manuscripts, segment
from folioloom.operators import events as ev
from folioloom.plans import registry, text_queries
from folioloom.sources import paged

ECMASCRIPT = "\t\n\x0b\f\r                  　﻿"


def test_white_space(spark):
    """White space is ECMAScript's, of all characters."""
    rows = spark.createDataFrame([(chr(k),) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000], "c string")
    white = {r.c for r in rows.where((text.payload(F.col("c")) == "") | (text.word_count(F.col("c")) == 0) | (text.js_trim(F.col("c")) == "")).collect()}
    agreed = {r.c for r in rows.where((text.payload(F.col("c")) == "") & (text.word_count(F.col("c")) == 0) & (text.js_trim(F.col("c")) == "")).collect()}
    assert white == agreed == set(ECMASCRIPT)


@pytest.mark.parametrize("make", [text.word_count, text.payload, text.js_trim])
def test_white_space_is_found_fast(spark, make):
    """A pass for white space costs little more than one for ASCII white space; a list of characters took five to ten times as long."""
    rows = spark.range(400).select(F.repeat(F.concat(F.lit("éle word "), F.col("id").cast("string")), 4000).alias("t")).cache()
    rows.count()

    def seconds(c):
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            rows.agg(F.sum(F.hash(c))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(make(F.col("t"))) < 3 * seconds(F.regexp_count("t", F.lit("\\S+"))) + 0.2


def test_integrity_texts_are_counted_once(spark):
    """The gate's plan asks each text for its words once for the counts and once for short chapters."""
    record = "named_struct('verified', true, 'source_sha', '', 'rebuilt_sha', '', 'source_words', 1L, 'rebuilt_words', 1L, 'coverage', 1d, 'min_words', 1L, 'max_words', 1L, 'suspicious', 0L, 'source_start', '', 'source_end', '', 'rebuilt_start', '', 'rebuilt_end', '')"
    books = spark.range(1).selectExpr("array('english classics') AS tags", f"{record} AS integrity", "array(named_struct('title', 'a', 'content', 'b')) AS chapters")
    plan = ingest.integrity_errors(books)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp_count", plan)) <= 2


def test_slug_matches_broadcasts_one_row(spark):
    """Names and slugs grow with the tables: only the single row of nameless ids may go through the driver."""
    slugs = spark.createDataFrame([("the-red-fox-1",), ("red_fox",), ("fox",), ("1-02_red_fox",), ("2_red_fox",), ("no",), ("",), ("_red_fox",)], "slug string")
    ids = spark.createDataFrame([("2001-01-02_red_fox",), ("2001-01-01_red_fox",), ("2001-01-03_big_red_fox",), ("2000_",), ("x2000_",), (None,)], "book_id string")
    found = audit.match_ids(slugs, ids)
    got = {r.slug: r.book_id for r in found.collect()}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    books = sorted(r.book_id for r in ids.collect() if r.book_id)
    meets = lambda s, b: b.endswith(s) or b.split("_", 1)[1] in s.replace("-", "_")
    assert got == {s: next((b for b in books if s and meets(s, b)), None) for s in got}
    assert len(got) == 8


def test_lines_like_headings_are_text_of_marked_chapters(spark):
    """Of the headed documents' sections each begins at a mark, though a line looks like a numbered heading."""
    told = "\n".join(f"# Chapter {n}: Part\n" + "word " * 60 + ("\nVi. La." + "\n" + "word " * 60 if n == 2 else "") for n in (1, 2, 3))
    rows = spark.createDataFrame([(1, told)], "doc_id long, text string")
    assert [r.kind for r in segment.sections(rows, profile=text_queries.MARKED).orderBy("number").collect()] == ["structural"] * 3
    assert segment.integrity(rows, profile=text_queries.MARKED).first().chapters == 3


def test_headed_queries_cut_at_marks_alone(spark, tmp_path):
    lines = ["word " * 60, "word " * 60, "Vi. La.", "word " * 60, "word " * 60]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, value in (("boundary_kinds", [("structural", 2)]), ("classic_sections", [1, 2]), ("classic_integrity", 2)):
        rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
        got = [tuple(r) for r in rows] if name == "boundary_kinds" else [r.number for r in rows] if name == "classic_sections" else rows[0].chapters
        assert got == value, name


def test_numbers_out_of_order_are_text(spark, tmp_path):
    """A line with a number that is not the next chapter's is no heading where chapters are numbered in order."""
    rows = spark.createDataFrame([(1, "Preface\nmore\n1) One\na\n187.231.175 b\n2. Two\n12:30 c\n1. d\n## Chapter 3: Three\ne"), (2, "5. x\n6. y"), (3, None)], "doc_id long, text string")
    found = manuscripts.numbered_chapters(rows, in_order=True).orderBy("doc_id", "number").collect()
    assert sorted((r.doc_id, r.number, r.title, r.content) for r in found) == [(1, 1, "Chapter 1", "more"), (1, 1, "One", "a\n187.231.175 b"), (1, 2, "Two", "12:30 c\n1. d"), (1, 3, "Three", "e"), (2, 1, "Chapter 1", "6. y")]
    assert manuscripts.numbered_chapters(rows).where("doc_id = 2").count() == 2
    lines = ["a", "187.231.175 b", "c", "d"]
    spark.createDataFrame([(2, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.number, r.title) for r in registry.QUERIES["numbered_importer"](spark, str(tmp_path)).collect()) == [(1, "Part no. 1"), (2, "Part no. 2")]


def test_debounced_orders_unknown_ids_last(spark):
    """Of events of one time the one without an id is the last, as in SQL."""
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "a", at), (None, "a", at), (2, "b", at), (3, "b", None), (None, "b", None)], "event_id long, key string, created_at timestamp")
    assert sorted((r.key, r.event_id is None, r.event_id) for r in ev.debounced(rows, "key").collect()) == [("a", True, None), ("b", False, 2), ("b", False, 3), ("b", True, None)]


def test_word_chunks_split_a_text_once(spark):
    """Time grows with the text, not with its square; each run's own split of 400,000 words would take minutes."""
    words = 400_000
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), words).alias("text"))
    start = time.perf_counter()
    found = formatting.word_chunks(rows, size=100).agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
    assert (found.n, found.words) == (words // 100, words) and time.perf_counter() - start < 30


def test_resumed_chunks_deal_out_their_pieces(spark, sf_dir):
    """The pieces lie in as many files as there are shuffle partitions: what one task reads shrinks with them."""
    files = []
    write = DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        write(self, path, *args, **options)
        if path.endswith("/pieces"):
            files.append(len(spark.read.parquet(path).inputFiles()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(DataFrameWriter, "parquet", noted)
            found = registry.QUERIES["resumed_chunks"](spark, sf_dir)
        pieces = formatting.word_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=100)
        assert found.count() == pieces.count() and files == [12]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_waits_of_pages_are_their_own(monkeypatch):
    """Who takes the place of the paged source's waits gets those alone, not those of Py4J's worker, which sleeps by the second."""
    waits = []
    tasks = deque()
    worker = clientserver.FinalizerWorker(tasks)
    worker.daemon = True
    with monkeypatch.context() as patch:
        patch.setattr(paged.time, "sleep", waits.append)
        worker.start()
        with pytest.raises(OSError):
            paged.HttpPages("http://127.0.0.1:1/rows")._get(5, 0)
        time.sleep(0.1)
        found = list(waits)
    tasks.append(clientserver.SHUTDOWN_FINALIZER_WORKER)
    worker.join(5)
    assert found == [0.5, 1, 2, 4]
