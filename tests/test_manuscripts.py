"""Chapters as column expressions against the same rules one line at a time."""

import random

import brute_manuscripts as brute
import pytest

from folioloom.operators import manuscripts

PIECES = [
    "# Chapter 1: The Start", "Chapter Two — On", "## Chapter Twenty-One: Far", "Chapter Twenty-One", "# Chapter Twenty - One Night", "Sura ya kumi na mbili: Safari", "## Sura ya Kwanza", "sura 3 - x", "# Chapter one hundred: C",
    "# Chapter 7 Night", "Chapter 7 Night", "# Chapter Zero", "# Chapter 0: none", "Chapter Nineteen", "   # CHAPTER  IX: no", "Chapter 5", "x # Chapter 3: glued", "# Sura ya ishirini na tisa", "Chapter 12:", "Chapter 3 : a - b: c", "### sura ya mia moja – Z",
    "1. One", "4) Four", "## Chapter 2: Two", "chapter 9 . Nine  ", "第二章 B", "第3章", "Section 4", "part two", "10. ten", "10.ten", "plain words here", "", "  ", "\ttabbed", "---", "a\r", "no heading: 4", "Author: Jane W. Doe", "**Mwandishi: Asha Ali**", "## Two Words", "## one two three four five six",
    "# THE RED MOON", "# Chapters of x", "Sura yake", "chapterhouse 4: x", "Chapter\t8:\tTabs",
]
NAMES = ["x.md", "mobile_red_moon_final_en_v2.md", "salt_road_sw_TOLEO_LILILOPANULIWA.md", "swahili tale.txt", "a-en.txt", "english_x.md", "", None, "étoile_sw_final_expanded_v1_2.md", "don't_stop.md"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    made += [f"---\nx: y\n---\n{t}" for t in made[:60]] + [f"---\n{t}" for t in made[60:80]]
    made += ["\n\n".join("w" * rng.randint(1, 2500) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    return [*made, "", None, "\n\n\n", "one\r\n\r\ntwo"]


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame([(k, NAMES[k % len(NAMES)], t) for k, t in enumerate(texts)], "doc_id long, name string, text string").cache()


def compared(frame, texts, make):
    found = {}
    for row in frame.collect():
        found.setdefault(row.doc_id, []).append(tuple(row)[1:])
    for k, t in enumerate(texts):
        expected = make(t or "")
        assert sorted(found.get(k, []), key=str) == sorted(map(tuple, expected), key=str), (t, found.get(k), expected)


@pytest.mark.parametrize(("make", "one"), [("marked_chapters", "marked_chapters"), ("numbered_chapters", "numbered_chapters"), ("plain_chapters", "text_chapters"), ("heading_parts", "heading_chunks")])
def test_chapters(rows, texts, make, one):
    compared(getattr(manuscripts, make)(rows), texts, getattr(brute, one))


def test_problems(rows, texts):
    compared(manuscripts.problems(rows), texts, lambda t: [(p,) for p in brute.manuscript_problems(t)])


def test_descriptions(rows, texts):
    found = {r.doc_id: tuple(r)[1:] for r in manuscripts.described(rows).collect()}
    for k, t in enumerate(texts):
        name = NAMES[k % len(NAMES)] or ""
        assert found[k] == (brute.infer_language(t or "", name), brute.infer_title(t or "", name), brute.infer_author(t or "")), (name, t)


def test_orders_of_chapters(rows, spark):
    one = spark.createDataFrame([(1, "# Chapter 2: B\nb\n# Chapter 1: A\na")], "doc_id long, text string")
    assert [tuple(r) for r in manuscripts.marked_chapters(one).collect()] == [(1, 2, "B", "b"), (1, 1, "A", "a")]
