"""Language ID on held-out rows and SimHash components against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from folioloom.llm import components, language_id, queries, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", 1, "y") for k, t, lang in rows], SCHEMA)


def test_language_accuracy(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "n_chars")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_kernel_is_the_presence_kernel(monkeypatch):
    texts, labels = ["the cat sat", "el gato come", "the dog ran", "los gatos comen"], ["en", "es", "en", "es"]
    model = language_id.fit(texts, labels)
    kernel = model.kernel(texts)[0]
    monkeypatch.setattr(language_id, "DENSE_CELLS", 0)
    assert model.kernel(texts)[0] == pytest.approx(kernel)
    sets = []
    for t in texts:
        codes, _, _ = language_id.gram_codes([t])
        sets.append(set(codes.tolist()))
    order = [0, 1, 2, 3] if len(model.size) == 4 else []
    queue = [0, 1, 2, 3]  # languages in turn: en 0, es 1, en 2, es 3
    for i in range(4):
        for j in order:
            other = sets[queue[j]]
            assert kernel[i, j] == pytest.approx(len(sets[i] & other) / (len(sets[i]) * len(other)) ** 0.5, rel=1e-5)


def test_long_texts_come_in_parts(monkeypatch):
    model = language_id.fit(["the cat sat on the mat", "el gato come la sopa"], ["en", "es"])
    text = "The cat, sat. " * 400 + "word" * 100 + " come\n" * 300
    whole, has = model.presence([text, "", "mat"])
    monkeypatch.setattr(language_id, "PART", 500)
    cut, also = model.presence([text, "", "mat"])
    assert (whole == cut).all() and has.tolist() == also.tolist() == [True, False, True]


def test_language_edges(spark):
    rows = [(k, f"the quick brown fox number {k}", "en") for k in range(30)] + [(k, f"der schnelle braune fuchs {k}", "de") for k in range(30, 60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 ?!\n", "de"), (103, "the fox " * 9000, None), (None, "the brown fox", "en"), (104, "漢字", None), (104, "漢字", None)]
    got = {}
    for r in language_id.identify(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[104]) == 2
    assert [got[k][0].lang_pred for k in (100, 101, 102)] == ["und"] * 3
    assert got[104][0].lang_pred in ("de", "en") and got[104][0].score == 0
    assert got[103][0].lang_pred == "en" and got[None][0].lang_pred == "en" and got[None][0].held_out is False
    assert all(got[k][0].lang_pred == ("en" if k < 30 else "de") for k in range(60))
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "a text", None)])).collect()} == {"und"}
    assert language_id.identify(frame(spark, rows).limit(0)).count() == 0


def test_many_languages(spark):
    """More languages than landmarks, and one that has only very long texts."""
    rng = random.Random(2)
    words = [["".join(chr(0x4E00 + 10 * lang + rng.randrange(10)) for _ in range(3)) for _ in range(9)] for lang in range(300)]
    rows = [(1000 * lang + k, " ".join(rng.choice(words[lang]) for _ in range(12)), f"l{lang:03d}") for lang in range(300) for k in range(12)]
    rows += [(500_000 + k, "ωδη " * 9000, "long") for k in range(9)] + [(7, "repeated", "l000")] * 3000
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows).repartition(4)).collect()}
    held = [r for k, r in got.items() if r.held_out and k != 7]
    lang = {k: lang for k, _, lang in rows}
    assert len(held) > 900
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for k, r in got.items() if k >= 500_000} == {"long"}


# --- SimHash


def brute_fingerprint(text, width=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lower + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_masks_cover():
    rng = random.Random(5)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        hits = [k for k, m in enumerate(simhash_dedup.MASKS) if not diff & m]
        assert hits
        assert any(not diff & m for m in simhash_dedup.INNER_MASKS[hits[0]])
    assert max(64 - m.bit_count() for m in simhash_dedup.MASKS) <= 32


@pytest.mark.parametrize("hot", [simhash_dedup.HOT_BUCKET, 1])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = random.Random(7)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps} | {0, 1, 7})
    table = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = {r.node: r.root for r in components.connected(simhash_dedup.links(table, hot=hot)).collect()}
    expected = brute_components([f % (1 << 64) for f in fps])
    least = {}
    for f, c in zip(fps, expected, strict=True):
        least[c] = min(least.get(c, f), f)
    assert {f: found.get(f, f) for f in fps} == {f: least[c] for f, c in zip(fps, expected, strict=True)}


def test_star_edges_span():
    values = np.array([0, 1, 3, 7, 15, 1 << 40, (1 << 40) | 7, 1 << 50 | 63 << 20], dtype=np.uint64)
    edges = simhash_dedup.star_edges(values)
    assert len(edges) == 6 and len({e[1] for e in edges}) == 6


TEXTS = [None, "", " \t\n", "One", "one", "ONE two", "a b c d e f g h i j k l m n o p", "A b c d e f g h i j k l m n o p", "É x y z", "é x y z", "w " * 30000, "a b c d e f g h i j k l m n o p q"]


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_shingle_widths(width):
    for text in TEXTS:
        got = simhash_dedup.fingerprint(simhash_dedup.shingle_hashes((text or "").encode(), width))
        assert got == brute_fingerprint(text, width)


def test_simhash_query(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)] + [(20, "One", None), (20, "One", None), (None, "one", None)]
    got = simhash_dedup.clusters(frame(spark, rows)).select("doc_id", simhash_dedup.fingerprint_hex(simhash_dedup.F.col("fp")).alias("f"), "component_id").collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    groups = brute_components(fps)
    low = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None) for g in set(groups)}
    expected = [(k, f"{f:016x}", low[g]) for (k, _, _), f, g in zip(rows, fps, groups, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert simhash_dedup.clusters(frame(spark, rows).limit(0)).count() == 0


def test_simhash_of_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in queries.op8_simhash_dedup(spark, sf_dir).collect()}
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[k]) for k in ids]
    assert [got[k].fingerprint for k in ids] == [f"{f:016x}" for f in fps]
    groups = brute_components(fps)
    low = {g: min(i for i, h in zip(ids, groups, strict=True) if h == g) for g in set(groups)}
    assert [got[k].component_id for k in ids] == [low[g] for g in groups]
