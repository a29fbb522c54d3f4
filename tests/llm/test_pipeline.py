"""The corpus pipeline, stage by stage, against brute force."""

import random
import re

import pytest
from test_language_simhash import brute_components, brute_fingerprint
from test_search_pack_toxic import brute_passages, check_sequences

import corpus_pipeline
from folioloom.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(30)) for k in range(3)]
    passage = prose(90)
    rows = [(k, prose(rng.randint(3, 200)), "xx") for k in range(60)]
    rows += [(100 + k, rows[k][1], "xx") for k in range(5)] + [(110, rows[9][1], None), (110, rows[9][1], None)]
    rows += [(120 + k, prose(30) + " " + passage + " " + prose(30), "xx") for k in range(4)] + [(130, passage, "xx")]
    rows += [(140 + k, prose(20) + " " + items[k][1] + " " + prose(20), "xx") for k in range(3)]
    rows += [(150, None, "xx"), (151, "", "xx"), (152, "123 !", "xx"), (None, "abcde " + prose(20), "xx")]
    folder = tmp_path_factory.mktemp("made")
    docs = spark.createDataFrame([(k, t, lang, "s", len(t) if t else None) for k, t, lang in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def brute_stages(rows, items):
    length = corpus_pipeline.REPEAT_BYTES
    rows = [(k, t) for k, t, _ in rows if t and any(c.isalpha() for c in t)]
    yield rows
    groups = brute_components([brute_fingerprint(t) for _, t in rows])
    best = {}
    for (k, t), g in zip(rows, groups, strict=True):
        if g not in best or (k is None, k or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = (k, t)
    rows = list(best.values())
    yield rows
    seen = {}
    texts = [t.encode() for _, t in rows]
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        flags = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                flags[k : k + length] = [True] * length
        marked = bytes(b if f else 0 for b, f in zip(t, flags, strict=True))
        for run in re.finditer(rb"[^\0]+", marked):
            low, high = run.span()
            whole = [m for m in re.finditer(rb"\S+", t) if m.start() >= low and m.end() <= high]
            if len(whole) <= 50:
                flags[low:high] = [False] * (high - low)
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        if kept:
            out.append((key, kept.decode("utf-8", "ignore")))
    rows = out
    yield rows
    leaks = {k for k, _ in brute_passages(rows, items)}
    yield [r for r in rows if r[0] not in leaks]


def test_stages(spark, made):
    folder, rows, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], brute_stages(rows, items), strict=True):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        got = found.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(expected, key=str), name
        assert all(r.n_chars == len(r.text) for r in got), name
        docs = spark.createDataFrame(got, SCHEMA).repartition(3)
    check_sequences([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()], expected, packing.CAPACITIES)


CLASHES = ["_null", "_key", "_place", "h", "_t", "fp", "score", "lang_pred", "c1", "c2", "_bytes", "ranges", "n_bytes", "kept", "n_removed", "n_spans", "kept_sha256", "_blank", "item_id", "similarity", "piece", "coded", "bin_id"]


def test_clashing_columns(spark, made):
    folder, _, _ = made
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    wide = plain.select("*", *[plain["doc_id"].alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, folder)
        assert found.columns == wide.columns, name
        rows = found.collect()
        assert all(r[c] == r.doc_id for r in rows for c in CLASHES), name
        assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(map(tuple, stage(spark, plain, folder).select("doc_id", "text").collect()), key=str), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() > 0


def test_empty(spark, made, tmp_path):
    folder, _, _ = made
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    assert corpus_pipeline.language(spark, docs, sf_dir).count() == docs.count()
