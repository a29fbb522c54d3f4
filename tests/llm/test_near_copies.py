"""Near copies of the pipeline against brute-force five-word similarity."""

import itertools
import random

import pytest

import corpus_pipeline
from folioloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts):
    for t in texts:
        words = (t or "").lower().split()
        yield {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_kept(rows):
    sets = list(brute_sets(t for _, t in rows))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            root[find(i)] = find(j)
    best = {}
    for k, (key, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 0)), (key is None, key or 0))
    return sorted(best.values())


def planted(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(60):  # pairs of 0.8 to 0.9: a few words changed, each of which changes five shingles
        words = [word() for _ in range(rng.randint(60, 400))]
        other = list(words)
        for at in range(10, len(words) - 5, 55):
            other[at] = "changed"
        rows += [" ".join(words), " ".join(other)]
    base = [word() for _ in range(150)]
    for k in range(40):  # a chain: neighbours are alike, the ends are not
        base[(k * 7) % 150] = word()
        rows.append(" ".join(base))
    frame = [word() for _ in range(100)]
    rows += [" ".join(frame + [word() for _ in range(40 + k % 3)]) for k in range(40)]  # alike, but below 0.8
    rows += [None, " ", "one two", "One  two", rows[0].upper()]
    return [(k, t) for k, t in enumerate(rows)] + [(None, rows[5])]


@pytest.mark.parametrize("small", [2, 8])
def test_stage_links_at_eight_tenths(spark, tmp_path, small):
    rows = planted(random.Random(4))
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).repartition(3)
    if small == near_copies.SMALL:
        kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    else:
        kept = near_copies.deduplicate(docs, small=small)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_kept(rows)


def test_rows_of_one_key_and_empty(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "A b c d e f g"), (2, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.deduplicate(docs).collect()
    assert len(found) == 2 and {r.doc_id for r in found} == {1}
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_simhash_finds_candidates(spark, tmp_path, monkeypatch):
    """Without any candidate of the bands SimHash still meets what is alike almost all through; each link is verified."""
    monkeypatch.setattr(near_copies, "candidates", lambda banded, small: banded.selectExpr("band", "h AS a", "h AS b").limit(0))
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1500], "changed", *words[1501:]])), (3, " ".join(reversed(words))), (4, None), (5, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3, 4]


def test_print_pairs(spark):
    prints = [0, 1, 7, 15, 1 << 62, (1 << 63) - 1]
    rows = [(h, fp) for h, fp in enumerate(prints)] + [(10, 1), (11, 1)]
    found = {(r.a, r.b) for r in near_copies.print_pairs(spark.createDataFrame(rows, "h long, fp long")).collect()}
    root = {h: h for h, _ in rows}
    for a, b in found:
        root = {h: root[a] if r == root[b] else r for h, r in root.items()}
        assert a < b
    groups = {frozenset(h for h in root if root[h] == r) for r in root.values()}
    assert groups == {frozenset({0, 1, 2, 3, 4, 10, 11}), frozenset({5})}
