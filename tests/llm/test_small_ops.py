"""URL filter, token counts, Simple-8b and token output against brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import queries, simple8b, token_count, token_output, url_filter, words

DOCS = "doc_id long, text string, lang string, start long, extra array<int>"
TEXTS = [
    "The cat's MAT, 12 naïve cafés <|endoftext|> done.",
    "",
    None,
    " \n\t ",
    "日本語 ééé\u00a0x\u2003y e\u0301 \u0301z Σας ΣΑΣ",
    "word " * 5000,
    "x" * 3000,
    "The cat's MAT, 12 naïve cafés <|endoftext|> done.",
]


def docs(spark, texts=TEXTS):
    rows = [(k * 3, t, "en", 1, [1]) for k, t in enumerate(texts)]
    rows.append((None, "null id", None, None, None))
    return spark.createDataFrame(rows, DOCS)


# --- Simple-8b


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**64 - 1), st.integers(0, 50_000)), max_size=3000))
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words) == values).all()
    for block in range(len(offsets) - 1):
        part = simple8b.decode(words[offsets[block] : offsets[block + 1]])
        assert (part == values[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK]).all()


def test_simple8b_packs():
    words, _ = simple8b.encode(np.zeros(960, np.uint64))
    assert len(words) == 4
    words, _ = simple8b.encode(np.full(1024, 1000, np.uint64))
    assert len(words) < 1024 / 5


# --- token output


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    at, out = 0, []
    for doc_id, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_output(spark):
    frame = docs(spark)
    rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    folder = token_output.write_tokens(frame, queries.tokenizer_path("word_bpe_49k.json"), token_output.token_folder(spark))
    got = sorted((tuple(r) for r in token_output.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected_tokens(rows)


def test_token_output_of_documents(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect())
    got = sorted(tuple(r) for r in queries.op9_token_output(spark, sf_dir).collect())
    assert got == expected_tokens(rows)


def test_token_output_empty(spark):
    frame = docs(spark).limit(0)
    folder = token_output.write_tokens(frame, queries.tokenizer_path("word_bpe_49k.json"), token_output.token_folder(spark))
    assert token_output.read_tokens(spark, folder).count() == 0


def test_segment_ranges():
    ids = np.arange(5000, dtype=np.uint64) % 977
    payload = token_output.pack([1, None], np.array([3000, 2000]), ids)
    assert (token_output.read_range(payload, 2900, 4100) == ids[2900:4100]).all()
    assert token_output.unpack(payload)[0] == [1, None]


# --- token counts


def brute_count(text, scores):
    low = min(scores.values()) - token_count.BYTE_PENALTY
    total = 0
    for word in (text or "").encode().split():
        word = token_count.MARK + word.decode()
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [(best[k][0] + scores[word[k:end]], -(-best[k][1] + 1)) for k in range(end) if word[k:end] in scores]
            if word[end - 1] not in scores:
                n = len(word[end - 1].encode())
                options.append((best[end - 1][0] + n * low, -(-best[end - 1][1] + n)))
            best[end] = max(options)
        total += -best[-1][1]
    return total


def test_token_counts(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    scores = token_count.load_scores(path)
    frame = docs(spark)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame, path).collect()}
    small = {r.doc_id: brute_count(r.text, scores) for r in frame.collect() if len(r.text or "") < 3001}
    assert {k: got[k] for k in small} == small
    assert math.isfinite(got[5 * 3]) and got[3] == 0 and got[6] == 0
    assert token_count.count_tokens(frame.limit(0), path).count() == 0


def test_trie_shares_prefixes_and_may_be_emptied(monkeypatch):
    trie = token_count.CountTrie({"▁": -1.0, "a": -1.0, "ab": -1.5, "b": -1.0, "▁ab": -1.2})
    count = lambda *found: trie.counts(words.Words([b" ".join(found)])).tolist()
    assert count(b"ab", b"abab", b"ab") == [1, 2, 1]
    assert trie.nodes == 5  # the mark and abab, of which ab is a prefix
    monkeypatch.setattr(token_count, "STORE_WORDS", 1)
    assert count(b"abab", b"c") == [2, 2]


def test_counts_of_random_words(monkeypatch):
    rng = random.Random(3)
    scores = {"▁": -3.0, "\u00e9": -2.5} | {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 6))): -float(rng.randint(1, 9)) for _ in range(120)}
    trie = token_count.CountTrie(scores)
    found = ["".join(rng.choice("abcdé日𝒳") for _ in range(rng.choice([1, 3, 8, 20, 63, 64, 90]))) for _ in range(400)]
    got = trie.counts(words.Words([" ".join(found).encode()])).tolist()
    assert got == [brute_count(w, scores) for w in found]
    assert [trie.long_count(token_count.MARK + w) for w in found] == got


# --- URL filter


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, None, default)
    return host, path, best[2], best[3]


URLS = [
    "https://Example.COM/en/a",
    "http://www.example.com/en/",
    "http://a.www.example.com/en/x?q#f",
    "http://badexample.com/en/x",
    "x://com/",
    "http://com",
    "http://a.net/es/1",
    "http://net/fr/",
    "http://a-b.net/fr",
    "ftp://a.net:80/es/",
    "no scheme",
    "://",
    "http://x.com?/en/",
    "http://é.com/\n/en",
    "http://a..com/",
    "",
    None,
]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_url_filter(spark, limit):
    rules = [*url_filter.PAGE_RULES, ("a.www.example.com", "/", "block"), ("com", "/en/x", "block"), ("b.net", "", "block")]
    rows = [(k, u, "text") for k, u in enumerate(URLS * 3)] + [(None, "http://b.net", None), (None, "http://b.net", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = url_filter.apply_rules(frame, table, broadcast_bytes=limit).collect()
    key = str
    assert sorted((tuple(r) for r in got), key=key) == sorted(((k, *brute_url(u, rules)) for k, u, _ in rows), key=key)
    assert url_filter.apply_rules(frame.limit(0), table, broadcast_bytes=limit).count() == 0
    assert {r.rule for r in url_filter.apply_rules(frame, table.limit(0), broadcast_bytes=limit).collect()} == {None}
