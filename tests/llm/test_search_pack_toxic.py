"""Top-k, packing, toxicity and decontamination against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from folioloom.llm import decontaminate, packing, queries, topk, toxicity

# --- top-k


def brute_topk(rows, is_query, k=5):
    """rows: (vec_id, vector); every row is a candidate but the query's own."""
    fit = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (query, weights) in enumerate(fit):
        if query is not None and is_query(query):
            ranked = sorted((-sum(a * b for a, b in zip(weights, v)), i is None, i or 0) for c, (i, v) in enumerate(fit) if c != at)[:k]  # noqa: B905
            for rank, (score, none, i) in enumerate(ranked, 1):
                yield query, rank, None if none else i, max(-(1 << 63), min((1 << 63) - 1, -score))


def check_topk(spark, rows, kind, **options):
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows], f"vec_id long, embedding array<{kind}>, score string").repartition(5)
    got = topk.search(frame, topk.F.col("vec_id") % 10 == 0, **options).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_topk(rows, lambda i: i % 10 == 0), key=str)
    assert topk.search(frame.limit(0), topk.F.col("vec_id") % 10 == 0).count() == 0


def near(x):
    return float(np.float32(x))


@pytest.mark.parametrize("options", [{}, {"block": 16, "lane_rows": 50}])
def test_topk(spark, options):
    rng = random.Random(4)
    rows = [(k, [near(rng.uniform(-1, 1)) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, rows[3][1]) for k in range(40)]  # many ties
    rows += [(k, [near(rng.uniform(-1, 1)) for _ in range(6)]) for k in (0, 10, 10, 17)] + rows[:5]  # shared ids, repeated rows
    rows += [(None, [1.0] * 6), (None, rows[20][1]), (910, []), (911, [0.5, -0.5]), (920, [near(0.3)] * 9)]
    rows += [(900, None), (902, [1.0, None]), (903, [math.nan] * 6), (904, [math.inf] * 6)]
    check_topk(spark, rows, "float", **options)


def test_topk_of_large_components(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 0, 3, 12, 19, 24, 40, 70, 900]) for _ in range(3)]) for k in range(120)]
    rows += [(200 + k, [2.0**60, 1.0 + k, 0.0]) for k in range(12)] + [(300, [1.7e308, -1.7e308, 5e-324]), (310, [float(1 << 20)] * 3)]
    check_topk(spark, rows, "double", lane_rows=30)


def test_topk_groups(monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 500)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    raw = np.floor(rng.normal(0, 60, (2300, 24))) / 256
    lane = topk.Lane(5)
    lane.queries(np.arange(0, 2300, 50), list(range(0, 2300, 50)), raw[::50])
    for at in range(0, 2300, 130):
        lane.candidates(np.arange(at, min(at + 130, 2300)), list(range(at, min(at + 130, 2300))), raw[at : at + 130])
    got = lane.result().to_pydict()
    expected = list(brute_topk([(k, v.tolist()) for k, v in enumerate(raw)], lambda i: i % 50 == 0))
    assert list(zip(got["query_id"], got["vec_id"], got["score"], strict=True)) == [(q, i, s) for q, _, i, s in expected]


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-20, 20, (3000, 16)).astype(float)
    matrix[5:2000:50] = 250
    group, found = topk.Group(np.arange(3000), list(range(3000)), matrix), topk.Found(np.array([-1]), 5)
    group.search(found, np.arange(1), np.full((1, 16), 100.0))
    assert found.best[0] == [(-250 * 100 * 16, False, k) for k in (5, 55, 105, 155, 205)]
    assert group.reads <= 0.25 * 3000 * 16


# --- packing


def best_fit_by_piece(lengths, capacities, cost):
    """The rules piece by piece, written from the description: the used sizes of all bins.

    When no open bin holds a piece, bins for all pieces left of its length are of the size that costs least
    a token, filled greedily, longest first, with what is left.
    """
    left, bins = Counter(lengths), []
    for length in sorted(left, reverse=True):
        size = None
        while left[length]:
            fit = [b for b in bins if b[0] - b[1] >= length]
            if fit:
                min(fit, key=lambda b: b[0] - b[1])[1] += length
                left[length] -= 1
                continue
            if size is None:
                options = []
                for capacity in sorted(c for c in capacities if c >= length):
                    used, rest = 0, Counter(left)
                    while piece := max((n for n in rest if rest[n] and n <= capacity - used), default=0):
                        used += piece
                        rest[piece] -= 1
                    options.append((cost(min(c for c in capacities if c >= used)) / used, capacity))
                size = min(options)[1]
            bins.append([size, 0])
    return Counter(used for _, used in bins)


def test_packing_rules():
    rng = random.Random(2)
    for _ in range(60):
        caps = sorted(rng.sample(range(4, 80), rng.randint(1, 4)))
        lengths = [min(caps[-1], int(rng.expovariate(0.06)) + 1) for _ in range(rng.randint(1, 120))]
        packed = packing.Packing(dict(Counter(lengths)), caps)
        assert Counter(u for f, e, u, _ in packed.bins for _ in range(e - f)) == best_fit_by_piece(lengths, caps, packing.bin_cost)
        assert all(c == min(x for x in caps if x >= u) for _, _, u, c in packed.bins)


def check_packed(rows, lengths, capacities):
    """rows: (key, piece, n, bin, offset, used, capacity)"""
    assert Counter((k, p, n) for k, p, n, *_ in rows) == Counter((k, p, min(max(capacities), n - p * max(capacities))) for k, n in lengths if n and n > 0 for p in range(-(-n // max(capacities))))
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r[3], r[4])), key=lambda r: r[3]):
        own = list(own)
        at = 0
        for _, _, n, _, offset, used, capacity in own:
            assert offset == at
            at += n
            assert capacity == min(c for c in capacities if c >= used)
        assert at == own[0][5] and len({r[5] for r in own}) == 1


def test_packing(spark):
    rng = random.Random(6)
    lengths = [(k, int(rng.lognormvariate(4, 1.5))) for k in range(700)] + [(None, 3), (1, 3), (1, 3), (9, None), (10, 0), (11, 5000), *[(2000 + k, 7) for k in range(900)]]
    frame = spark.createDataFrame([(k, n, "x") for k, n in lengths], "doc_id long, n_tokens int, bin_id string").repartition(3)
    caps = (64, 256, 1024)
    check_packed([tuple(r) for r in packing.pack(frame, capacities=caps).collect()], lengths, caps)
    assert packing.pack(frame.limit(0)).count() == 0


def test_packing_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    lengths = [(k, 7 + k % 3) for k in range(1000)]
    frame = spark.createDataFrame(lengths, "doc_id long, n_tokens long").repartition(3)
    check_packed([tuple(r) for r in packing.pack(frame, capacities=(20, 50)).collect()], lengths, (20, 50))


def tokens_of(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return [[*e.ids, 2] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing_of_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    lengths = [(r.doc_id, len(ids)) for r, ids in zip(docs, tokens_of([r.text for r in docs]), strict=True)]
    rows = [tuple(r) for r in queries.op7_packing(spark, sf_dir).collect()]
    check_packed(rows, lengths, packing.CAPACITIES)
    used, held = sum(n for _, n in lengths), {r[3]: r[6] for r in rows}
    assert used / sum(held.values()) > 0.9


def check_sequences(rows, texts, capacities):
    """rows: (bin, capacity, n, keys, pieces, payload); texts: (key, text)"""
    from folioloom.llm import token_output

    expected = Counter()
    for (key, _), ids in zip(texts, tokens_of([t for _, t in texts]), strict=True):
        expected.update((key, at // max(capacities), tuple(ids[at : at + max(capacities)])) for at in range(0, len(ids), max(capacities)))
    got = Counter()
    assert len({r[0] for r in rows}) == len(rows)
    for _, capacity, n, keys, pieces, payload in rows:
        own, counts, _, _ = token_output.unpack(payload)
        ids = token_output.read_range(payload, 0, n).tolist()
        assert own == keys and counts.sum() == n == len(ids) and capacity == min(c for c in capacities if c >= n)
        ends = np.cumsum(counts).tolist()
        got.update((k, p, tuple(ids[e - c : e])) for k, p, c, e in zip(keys, pieces, counts.tolist(), ends, strict=True))
    assert got == expected


def test_sequences(spark):
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice(["the", "Book", "of,", "x9", "été"]) for _ in range(int(rng.lognormvariate(3, 1.2))))) for k in range(150)]
    texts += [(None, "a b"), (None, None), (7, ""), (7, ""), (900, "word " * 900)]
    frame = spark.createDataFrame([(k, t, 3) for k, t in texts], "doc_id long, text string, bin_id int").repartition(3)
    caps = (32, 64, 256)
    rows = packing.sequences(frame, queries.tokenizer_path("word_bpe_49k.json"), capacities=caps)
    check_sequences([tuple(r) for r in rows.collect()], texts, caps)
    assert packing.sequences(frame.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0



# --- toxicity


def test_odds_are_the_marginals():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1])
    emission = rng.normal(size=9)
    start, enter, leave, stay = 0.4, 0.7, 1.3, 2.1
    got = toxicity.Steps(lengths).marginals(emission, start, enter, leave, stay)
    at = 0
    for n in lengths:
        total, tagged = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = math.prod(math.exp(e) for e, t in zip(emission[at : at + n], tags, strict=True) if t)
            if n and tags[0]:
                weight *= start
            for a, b in itertools.pairwise(tags):
                weight *= {(0, 0): 1.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}[a, b]
            total += weight
            tagged += weight * np.array(tags)
        if n:
            assert got[at : at + n] == pytest.approx(tagged / total)
        at += n


def toxic_rows():
    rng = random.Random(8)
    common = ["the", "sun", "moon", "river", "stone", "tree", "cloud", "leaf", "bird", "road"]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(common) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Vileness", "vilest", "grotty"]))
        rows.append((k, " ".join(words) + ".", 0))
        labels.append((k, 1, int(toxic), "x"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None, 1), (1001, "", 1), (1002, "?!", 1), (1003, "the sun " * 20000 + "vilest", 1), (None, "vilest grotty vilest", 1), (1004, "moon", 1), (1004, "moon", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    table = spark.createDataFrame([*labels, (1, 1, None, "x"), (None, 1, 1, "x"), (0, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.rate(docs, table).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    held = [k for k in range(600) if by_id[k].held_out]
    assert len(held) > 60
    assert sum(by_id[k].predicted == (k % 4 == 0) for k in held) >= 0.97 * len(held)
    assert by_id[None].predicted == 1 and by_id[None].held_out is False
    assert [by_id[k].predicted for k in (1000, 1001, 1002, 1004)] == [0] * 4
    texts = {r[0]: r[1] for r in rows}
    found = {texts[0][s.start : s.end].lower() for s in by_id[0].spans}
    assert found <= {"vileness", "vilest", "grotty"} | {f"{a} {b}" for a in ("vileness", "vilest", "grotty") for b in ("vileness", "vilest", "grotty")} and found
    assert toxicity.rate(docs.limit(0), table).count() == 0
    assert {r.score for r in toxicity.rate(docs, table.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in toxicity.rate(docs, table.where("toxic = 1")).collect()} == {1}


def test_spans_are_places_of_the_text(spark):
    rows, labels = toxic_rows()
    rows += [(2000, "İİ the sun İ Vilest, grotty", 0), (2001, "ẞ VILENESS", 0)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string, spans int"), spark.createDataFrame([(k, t) for k, _, t, _ in labels], "doc_id long, toxic int")
    got = {r.doc_id: [rows[-2 if r.doc_id == 2000 else -1][1][s.start : s.end] for s in r.spans] for r in toxicity.rate(docs, table).where("doc_id >= 2000").collect()}
    assert got == {2000: ["Vilest, grotty"], 2001: ["VILENESS"]}


def test_toxicity_sample():
    words = [f"w{k}" for k in range(40)]
    ranked = sorted(words, key=lambda w: zlib.crc32(w.encode()))
    near, far = ranked[:39], ranked[:3] + ranked[20:]  # both have the three least hashes
    texts = [" ".join(x) for x in (words, near, far, words)]
    # copies of one label go; another label, or unlike texts, stay
    assert toxicity._first_of_copies(texts, np.array([0, 0, 0, 1])).tolist() == [0, 2, 3]


def test_labels_without_documents(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(k, t + " filler" * 5000 if k % 4 == 0 else t, 0) for k, t, _ in rows] + [(0, "again", 0)] * 50, "doc_id long, text string, score int")
    table = spark.createDataFrame([(k, t) for k, _, t, _ in labels] + [(k, k % 2) for k in range(10_000, 16_000)], "doc_id long, toxic int")
    got = [r for r in toxicity.rate(docs, table).where("held_out").collect() if r.doc_id]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)


def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels")
    rows = got.join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 40
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.03 * len(clean)


# --- decontamination


def brute_passages(docs, items):
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    items = [(i, decontaminate.words_of(t)) for i, t in items]
    out = {}
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, own in items:
            n = len(own)
            if not n:
                continue
            target = shingles(own)
            best = max((sum((s & target).values()) / sum((s | target).values()) for s in (shingles(words[a : a + n]) for a in range(len(words) - n + 1))), default=0)
            if best >= 0.8:
                out[d, i] = best
    return out


def test_passages(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 60)))) for k in range(25)] + [(90, "too short here"), (91, None), (None, "a b c d e f"), (92, "、 ... !"), (93, "東京都は日本の首都であり世界最大の都市の一つである"), (94, "Oneword!")]
    docs = [(500, "it is Too  short, here"), (501, "x 東京都は日本の首都であり世界最大の都市の一つです。"), (502, "東京都は日本"), (503, "oneword"), (504, "onewords too short")]
    for k in range(80):
        words = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            passage = items[k % 25][1].split()
            if k % 3 == 0 and len(passage) > 30:
                passage[rng.choice([0, -1, 1])] = "changed"
            if k % 5 == 0:
                passage = [w.upper() + rng.choice([",", ".", "***", " |"]) for w in passage]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((k, " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, (items[3][1] + " ") * 200), (202, "x " * 30000 + items[4][1])]
    frame = spark.createDataFrame([(k, t, 7) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_passages([(n, t) for n, (_, t) in enumerate(docs)], [x for x in items if x[0] is not None and x[1]])
    expected = sorted((str(docs[n][0]), i, round(v, 9)) for (n, i), v in expected.items())
    assert len(expected) > 30
    for limit in (decontaminate.PART_BYTES, 900):
        monkeypatch.setattr(decontaminate.parts, "__defaults__", (limit,))
        got = decontaminate.passages(frame, bench, ["doc_id"]).collect()
        assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in got) == expected
        kept = decontaminate.clean(frame, bench).collect()
        assert {r.doc_id for r in kept} == {k for k, _ in docs} - {None if k == "None" else int(k) for k, _, _ in expected}
    assert decontaminate.passages(frame, bench.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.passages(frame.limit(0), bench, ["doc_id"]).count() == 0
