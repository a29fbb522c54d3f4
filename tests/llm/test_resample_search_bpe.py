"""Importance resampling, ranked search and byte-level BPE against brute force and the public library."""

import codecs
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import byte_bpe, importance, lexical, queries, terms

DOCS = "doc_id long, text string, term string, _no long, share long, score long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "the river and the mill by the river " * 6,
    "The RIVER, and the mill; by the river!",
    "",
    None,
    " \n\t .,;",
    "Été à la rivière 日本語 été " * 8,
    "x" * 300 + " y " + "z" * 90,
    "alone",
    "the river and the mill by the river " * 6,
]


def table(spark, texts=TEXTS, first=0):
    rows = [(first + 3 * k, t, "a", 1, 2, 3) for k, t in enumerate(texts)]
    rows.append((None, "the null river " * 9, None, None, None, None))
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return WORD.findall((text or "").encode().lower())


# --- terms


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aB9 -é日\n", max_size=30), min_size=1, max_size=6), st.integers(1, 9))
def test_terms_are_the_pattern_s(texts, limit):
    raw = [t.encode() for t in texts]
    found = terms.Terms(raw)
    assert found.listed() == [w for t in texts for w in words_of(t)]
    assert found.counts.tolist() == [len(words_of(t)) for t in texts]
    for t in raw:
        cut = list(terms.parts(t, limit))
        assert b"".join(cut) == t
        assert [w for p in cut for w in terms.Terms([p]).listed()] == words_of(t.decode())


# --- importance resampling


def brute_features(text, longest=2):
    w = words_of(text)
    return len(w), [zlib.crc32(b" ".join(w[k : k + n])) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute_resample(rows, target, buckets=10_000, percent=25, least=20):
    own = [(key, *brute_features(t)) for key, t in rows]
    s, t = Counter(c % buckets for _, _, f in own for c in f), Counter(c % buckets for x in target for c in brute_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    scored = []
    for key, n, f in own:
        weight = math.floor(sum(gain[c % buckets] for c in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in scored), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_checksums_of_joined_terms(longest):
    texts = ["one two three four", "", "q" * 200 + " b " + "é" * 70, "last"]
    owner, sums = importance.features(terms.Terms([t.encode() for t in texts]), longest)
    expected = [(k, c) for k, t in enumerate(texts) for c in brute_features(t, longest)[1]]
    assert sorted(zip(owner.tolist(), sums.tolist(), strict=True)) == sorted(expected)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = ("ein kleiner Fluss, " * 40 + "langeswort" * 9 + " Ende ") * 3
    whole = importance._rows([text.encode()], 500, 3)
    monkeypatch.setattr(terms, "PART_BYTES", 50)
    monkeypatch.setattr(terms.parts, "__defaults__", (50,))
    cut = importance._rows([text.encode()], 500, 3)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_resample_matches_brute_force(spark):
    rng = random.Random(3)
    more = [" ".join(rng.choice(["river", "mill", "der", "fluss", "stone", "été"]) for _ in range(rng.randint(5, 60))) for _ in range(150)]
    docs = table(spark, TEXTS + more).repartition(3)
    target = spark.createDataFrame([("the river and the mill",), (None,), ("stone mill",)], "text string")
    found = importance.resample(docs, target)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute_resample([(r.doc_id, r.text) for r in docs.collect()], ["the river and the mill", None, "stone mill"])
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1))


def test_resample_of_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "word " * 30)] * 9, "doc_id long, text string")
    empty = docs.limit(0)
    assert sorted(r["rank"] or 0 for r in importance.resample(docs, empty).collect()) == [0] * 7 + [1, 2]
    assert importance.resample(empty, docs).collect() == []
    assert [r["rank"] for r in importance.resample(docs.limit(1), docs).collect()] == [None]


def test_importance_matrix_is_compressed_rows(spark):
    [block] = importance.matrix(table(spark).coalesce(1), "doc_id").collect()
    starts, columns, counts = (np.frombuffer(block[c], k) for c, k in (("indptr", "<i8"), ("indices", "<u2"), ("counts", "<u4")))
    for k, (key, size) in enumerate(zip(block["keys"], block["n_features"], strict=True)):
        text = next(r.text for r in table(spark).collect() if r.doc_id == key)
        own = slice(starts[k], starts[k + 1])
        assert dict(zip(columns[own].tolist(), counts[own].tolist(), strict=True)) == Counter(c % 10_000 for c in brute_features(text)[1])
        assert counts[own].sum() == size


# --- ranked search


def brute_search(rows, items, k=50):
    own = [(key, Counter(words_of(t))) for key, t in rows]
    own = [(key, c) for key, c in own if c]
    n_docs, all_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words_of(text)) if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank, None if unknown else key, -s) for rank, (s, unknown, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "segment_docs", "block_bytes"), [(3, 7, 1 << 20), (50, 4096, 40), (2, 2, 60), (200, 16, 1 << 20)])
def test_search_matches_brute_force(spark, k, segment_docs, block_bytes):
    rng = random.Random(k)
    vocabulary = [f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(400)]
    more = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(160)] + ["w1 w2 w3"] * 25
    docs = table(spark, TEXTS + more).repartition(3)
    items = [(1, "the river w1"), (2, None), (None, "w2 w3 W2 w9 nowhere"), (4, ""), (1, "été 日本語"), (6, "nothing matches"), (7, " ".join(f"w{j}" for j in range(61)))]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(docs, asked, k, block_bytes=block_bytes, segment_docs=segment_docs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search([(r.doc_id, r.text) for r in docs.collect()], items, k)


def test_search_reads_no_more_than_the_cuts(spark):
    """Rare terms decide: of the frequent term's list only the part above the cut is fetched."""
    rows = [(k, "common " + "filler " * (k % 50) + ("rare gem " * 9 if k % 40 == 0 else "")) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = lexical.Items([b"common", b"gem", b"rare"], [0], [np.array([0, 1, 2])])
    index = lexical.build(docs, "doc_id", items.terms)
    lists = lexical.postings(index)
    low = lexical.first_bounds(lists, items, index.weight, 5)
    cut = lexical.cuts(items, index.weight, low)
    size = {r["term"]: r["n"] for r in lexical.fetch(lists, cut).selectExpr("term", "octet_length(slots) div 4 as n").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert size.get(0, 0) == 0 and 5 <= size[1] == size[2] < 20


def test_search_of_empty_tables(spark):
    docs, empty = table(spark), table(spark).limit(0)
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert lexical.search(empty, items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert lexical.search(blank, items).collect() == []


def test_counts_of_a_long_text_in_parts(monkeypatch):
    text = "river mill stone, river " * 50
    place = {b"river": 0, b"stone": 1}
    whole = lexical._counted([text.encode()], place)
    monkeypatch.setattr(terms, "PART_BYTES", 40)
    monkeypatch.setattr(terms.parts, "__defaults__", (40,))
    assert all((a == b).all() for a, b in zip(whole, lexical._counted([text.encode()], place), strict=True))


# --- byte-level BPE

MULTI = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.tokenizer_path(MULTI))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def transducer(public):
    return byte_bpe.Transducer(public[0])


def test_transducer_is_the_library_s(public, transducer, monkeypatch):
    ranks, library = public
    rng, tokens = random.Random(5), list(ranks)
    monkeypatch.setattr(byte_bpe, "MOST_STATES", 400)  # emptied often
    for _ in range(3000):
        kind = rng.random()
        if kind < 0.4:
            piece = bytes(rng.choice(b"aab  \xc3\xa9nthe") for _ in range(rng.randint(1, 60)))
        elif kind < 0.8:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        else:
            piece = bytes(rng.randrange(256) for _ in range(rng.randint(1, 20)))
        expected = library._core_bpe.encode_single_piece(piece)
        assert transducer.encode(piece) == expected
        assert transducer.merges.run(piece) == (expected if piece not in ranks else transducer.merges.run(piece))


def test_lookahead_is_bounded(transducer):
    longest = transducer.merges.longest
    held = [len(b"".join(transducer.merges.tokens[t] for t in kept)) for state in range(len(transducer.states)) for _, _, kept in transducer.places(state)]
    assert max(held) <= longest


def test_vocabulary_whose_parts_rank_higher():
    """"abc" has a lower rank than "ab", its only way: encoded by merges, as such a vocabulary must be."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"abc": 5, b"bc": 301, b"cd": 302, b"zz": 7, b"xyz": 303}
    tool = byte_bpe.Transducer(ranks)
    rng = random.Random(1)

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [bytes([b]) for b in piece]
        while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    for _ in range(400):
        piece = bytes(rng.choice(b"abcdxyz") for _ in range(rng.randint(1, 12)))
        assert tool.encode(piece) == plain(piece)
    assert not tool.merges.ordered
    assert tool.encode(b"xyz") == [303] and tool.encode(b"axyz") == plain(b"axyz")  # whole only


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([b"a", b"\xc3", b"\xa9", b"\xe2\x82", b"\xac", b"\xf0\x9f", b"\x98\x80", b"\xed\xa0", b"\xf4\x90", b"\xff", b"\xe0\x80"]), max_size=12), st.integers(1, 4))
def test_utf8_machine_is_the_incremental_decoder(found, step):
    data = b"".join(found)
    machine, library = byte_bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    out, expected = [], []
    for k in range(0, len(data), step):
        out.append(machine.feed(data[k : k + step]))
        expected.append(library.decode(data[k : k + step]))
    assert "".join([*out, machine.finish()]) == "".join([*expected, library.decode(b"", True)]) == data.decode("utf-8", "replace")


BPE_TEXTS = [*TEXTS, "It's <|endoftext|> we'll  see \r\n\n\x1c 　 x'S", "ไทย" * 400, "y" * 20_000, " " * 900 + "q", "1２½ 😀👩‍👩 ́é"]


def test_encoding_and_round_trip(spark, public, monkeypatch):
    import public_tokenizers

    _, library = public
    docs = table(spark, BPE_TEXTS).repartition(2)
    path = queries.tokenizer_path(MULTI)
    tokens = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "text"])
    found = byte_bpe.decode(tokens, path, ["doc_id", "n_tokens", "ids"]).collect()
    assert sorted(map(tuple, byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, ["doc_id"]).collect()), key=str) == sorted(map(tuple, found), key=str)
    by_key = {r.doc_id: r for r in found}
    assert len(found) == docs.count()
    for row in docs.collect():
        ids = library.encode_ordinary(row.text or "")
        got = by_key[row.doc_id]
        assert got.n_tokens == len(ids) and np.frombuffer(got.ids, "<u4").tolist() == ids
        assert bytes(got.decoded) == (row.text or "").encode() and got.text == (row.text or "")
    assert byte_bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN, ["doc_id"]).collect() == []


def test_decoding_streams(public):
    ranks, library = public
    tool = byte_bpe.Decoder(queries.tokenizer_path(MULTI))
    text = "naïve 😀 日本語 " * 20
    ids = np.array(library.encode_ordinary(text), "<u4")
    out = list(tool.stream(ids[k : k + 1] for k in range(len(ids))))
    assert "".join(out) == text and "�" not in "".join(out)


def test_store_keeps_what_is_asked_for(monkeypatch, public):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "STORE_PIECES", 5)
    tool = byte_bpe.Encoder(queries.tokenizer_path(MULTI), public_tokenizers.PATTERN)
    text = " ".join(f"word{k % 13}" for k in range(100))
    assert np.frombuffer(tool.ids(text), "<u4").tolist() == public[1].encode_ordinary(text)
    assert len(tool.words) <= 5 and len(tool.words.older) <= 5


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="ab'sé1½.,-日 \n\t\r\x1c\u00a0\u3000", max_size=40))
def test_units_are_split_as_the_whole(transducer_encoder, text):
    tool, library = transducer_encoder
    assert np.frombuffer(tool.ids(text), "<u4").tolist() == library.encode_ordinary(text)


@pytest.fixture(scope="module")
def transducer_encoder(public):
    import public_tokenizers

    tool = byte_bpe.Encoder(queries.tokenizer_path(MULTI), public_tokenizers.PATTERN)
    assert tool.units
    return tool, public[1]


def test_other_patterns_are_not_cut():
    assert byte_bpe.Encoder(queries.tokenizer_path(MULTI), r"\S+\s*|\s+").units is False


# --- the queries


def rows_of(spark, sf_dir, name):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def test_op11_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = queries.op11_importance_resampling(spark, sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_resample(docs, target)


def test_op12_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = queries.op12_lexical_search(spark, sf_dir)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(docs, items)


def test_op13_matches_the_library(spark, sf_dir, public):
    found = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = public[1].encode_ordinary(row.text or "")
        got = found[row.doc_id]
        raw = (row.text or "").encode()
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
