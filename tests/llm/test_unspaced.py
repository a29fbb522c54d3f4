"""Scripts without spaces, rules that disagree, and labels of long texts."""

import random

import numpy as np
import pytest

import corpus_pipeline
from folioloom.llm import near_copies, suffix_dedup, toxicity, unspaced, url_filter

JAPANESE = "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している"
THAI = "กาลครั้งหนึ่งนานมาแล้วมีชายชราคนหนึ่งอาศัยอยู่ในกระท่อมหลังเล็กริมแม่น้ำกับแมวสีขาวตัวหนึ่งซึ่งชอบนอนกลางวัน"


def made(signs, seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(signs) for _ in range(n))


def test_words():
    assert unspaced.word_count("naïve".encode()) == 1 and unspaced.word_count("猫である".encode()) == 4 and unspaced.word_count("“x”".encode()) == 1
    assert unspaced.spaced("a猫b é".encode()).decode().split() == ["a", "猫", "b", "é"]
    text = ("one two " + JAPANESE + " end").encode()
    assert suffix_dedup.whole_words(text, 0, len(text)) == 3 + len(JAPANESE)
    assert suffix_dedup.whole_words(text, 1, 7) == 1  # the end of one word, and a whole one
    low = len("one two ".encode()) + 3 * 5
    assert suffix_dedup.whole_words(text, low, low + 30) == 10  # characters go on, and are whole


def test_shingles_of_unspaced_texts():
    a, b = JAPANESE * 3, JAPANESE * 3 + "、終わり"
    assert len(near_copies.shingles(a.encode())) > 40
    assert near_copies.alike(near_copies.shingles(a.encode()), near_copies.shingles(b.encode()))
    assert not near_copies.alike(near_copies.shingles(a.encode()), near_copies.shingles(made(JAPANESE, 1, 200).encode()))


@pytest.mark.parametrize("signs", [JAPANESE, THAI])
def test_pipeline_stages_on_unspaced_texts(spark, signs, sf_dir):
    """Near copies go, repeated passages of over 50 characters go, other texts stay."""
    base = made(signs, 1, 400)
    near = base[:200] + "x" + base[201:]
    passage = made(signs, 2, 120)
    texts = [base, near, made(signs, 3, 300) + passage, passage + made(signs, 4, 300), made(signs, 5, 300)]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    found = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, kept, sf_dir).collect()}
    assert found == {0: base, 2: texts[2][:300], 3: texts[3][120:], 4: texts[4]}


def test_rules_that_disagree(spark):
    rules = spark.createDataFrame([("Example.COM", "/a", "allow"), ("example.com", "/a", "block"), ("net", "/", "review"), ("net", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.example.com/a/b"), (2, "http://x.net/"), (3, "http://other.org/")], "page_id long, url string")
    for size in (url_filter.BROADCAST_BYTES, 0):
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.apply_rules(pages, rules, broadcast_bytes=size).collect()} == {1: ("example.com/a", "block"), 2: ("net/", "allow"), 3: (None, "allow")}


def test_long_texts_are_learned_whole(spark, monkeypatch):
    """A passage at the end of a text counts as much as one at its beginning."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 300)
    rng = random.Random(4)
    clean = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = []
    for k in range(240):
        toxic = k % 2
        rows.append((k, clean(80) + (" vile scum rotten filth" * 3 if toxic else " mild calm gentle quiet" * 3), toxic))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_LONG", 120)
    found = {r.doc_id: r.predicted for r in toxicity.rate(docs, labels).collect()}
    assert np.mean([found[k] == y for k, _, y in rows]) > 0.95
