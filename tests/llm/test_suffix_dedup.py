"""Suffix sorting and removal of repeats against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import queries, suffix_dedup


@settings(deadline=None, max_examples=120)
@given(st.one_of(st.text("ab", max_size=60), st.text("abc\x00\xff", max_size=200)))
def test_suffix_array(text):
    data = text.encode("latin-1")
    array, _ = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 400)
    assert array.tolist() == sorted(range(len(data)), key=lambda k: data[k:])


def test_suffix_array_to_a_depth():
    data = b"ab" * 700 + b"a" * 900
    array, _ = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 400)
    assert sorted(array.tolist()) == list(range(len(data)))
    order = [data[k : k + 400] for k in array.tolist()]
    assert order == sorted(order)


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                flags[k : k + length] = [True] * length
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        spans = sum(1 for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1]))
        out.append((len(t), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_segments_cover_every_start():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 2000))) for _ in range(20)] + [b"a" * 1500]
    row, first, starts, _ = suffix_dedup.segments_of(texts, 100, 16)
    found = sorted((r, f + k) for r, f, s in zip(row.tolist(), first.tolist(), starts.tolist(), strict=True) for k in range(s))
    assert found == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 99)]


def made_texts(length):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(length // 4), prose(3 * length)
    texts = [None, "", "short", prose(400), long, long, long[: len(long) // 2] + prose(50)]
    texts += [prose(rng.randint(5, 60)) + passage + prose(rng.randint(5, 60)) for _ in range(12)]
    texts += [prose(40) + passage[:length] + prose(9) + passage[3 : length + 2] + prose(40), "ab" * length * 2, "z" * (length + 1), "y" * length, prose(9) + long[7 : 7 + length - 1]]
    return texts


@pytest.mark.parametrize(("length", "hot", "broadcast"), [(400, 2000, 9999), (400, 2, 9999), (400, 2, 0), (200, 2000, 9999)])
def test_removal(spark, monkeypatch, length, hot, broadcast):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_WINDOWS", broadcast)
    texts = made_texts(length)
    frame = spark.createDataFrame([(k if k % 7 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = suffix_dedup.remove_repeats(frame, ["doc_id"], length, hot).drop("kept").collect()
    expected = [(k if k % 7 else None, *x) for k, x in enumerate(brute([(t or "").encode() for t in texts], length))]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(x[2] for x in expected) > 0
    assert suffix_dedup.remove_repeats(frame.limit(0), ["doc_id"], length).count() == 0


def test_long_texts_are_cut(spark, monkeypatch):
    rng = random.Random(5)
    long, other = (bytes(rng.choices(b"abcdefgh", k=n)) for n in (70_000, 30_000))
    texts = [long, other, long[20_000:21_000] + other[:500]]
    row, first, starts, _ = suffix_dedup.segments_of(texts, 400, part=1 << 12)
    found = sorted((r, f + k) for r, f, s in zip(row.tolist(), first.tolist(), starts.tolist(), strict=True) for k in range(s))
    assert found == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 399)]
    assert len(row) > len(suffix_dedup.segments_of(texts, 400)[0])
    # the default is looked up when the function runs, so the tasks of this session's workers may cut too
    frame = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 12)
    batches = frame.select("text").toArrow().to_batches()
    cut = sum(b.column(6).to_numpy().sum() for b in suffix_dedup._anchors(batches, 400, 64))
    assert cut == sum(len(t) - 399 for t in texts)
    got = suffix_dedup.remove_repeats(frame, ["doc_id"]).drop("kept").collect()
    assert sorted(map(tuple, got)) == [(k, *x) for k, x in enumerate(brute(texts, 400))]


def test_sorting_of_deep_ties():
    rng = random.Random(8)
    base = bytes(rng.choices(b"ab", k=900))
    texts = [base, base[:450] + b"x" + base[451:], base[3:], b"ab" * 300, b"a" * 700, b"a" * 699 + b"b", base[:430]]
    got = suffix_dedup.repeated_starts(texts, 400)
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    assert [g.tolist() for g in got] == [[seen[t[k : k + 400]] > 1 for k in range(len(t) - 399)] for t in texts]


def test_words_of_runs(spark):
    passage = " ".join(f"wort{k:02d}" for k in range(30))
    texts = ["alpha " + passage + " omega", "other" + passage + "s end", "x y z"]
    frame = spark.createDataFrame([(k, t, "kept", 7) for k, t in enumerate(texts)], "doc_id long, text string, kept string, n_spans int")
    for least, gone in ((30, [True, False, False]), (31, [False] * 3), (28, [True, True, False])):
        rows = sorted(suffix_dedup.remove_repeats(frame, ["doc_id"], 100, least_words=least).collect())
        assert [r.n_removed > 0 for r in rows] == gone, least
    wide = suffix_dedup.remove_repeats(frame, ["doc_id", "kept", "n_spans"], 100)
    assert wide.columns == ["doc_id", "kept", "n_spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted(r[1] for r in wide.collect()) == ["kept"] * 3


def test_documents(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, sf_dir, "documents").collect()}
    got = sorted(tuple(r) for r in queries.op3_suffix_dedup(spark, sf_dir).collect())
    ids = sorted(docs)
    assert got == [(k, *x) for k, x in zip(ids, brute([docs[k] for k in ids], 400), strict=True)]
