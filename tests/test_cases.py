"""Written-out cases: the inputs stand beside the results that they must give, each written by hand from the rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioloom.functions import codes, text
from folioloom.operators import audit, events, ingest, manuscripts, publish

CASES = {}


def listed(name: str, columns: dict[str, str], expected: list[tuple]):
    """The decorated function gives these rows."""

    def keep(make):
        CASES[name] = (make, list(columns), expected)
        return make

    return keep


def of_column(name: str, kind: str, pairs: list[tuple], make) -> None:
    """One input text and its result a row."""

    @listed(name, {"input": "string", "result": kind}, pairs)
    def run(spark, d):
        rows = spark.createDataFrame([(a,) for a, _ in pairs], "input string")
        return rows.select("input", make(F.col("input")).alias("result"))


# --- paths

of_column(
    "excluded_paths",
    "boolean",
    [
        ("/shelf/s9_backup_b/moon_final_en.md", True),
        ("/shelf/x_隔离/moon_final_sw.md", True),
        ("/shelf/12 reports/list.md", True),
        ("/shelf/.moon_final_sw.mobile_work/parts/one.md", True),
        ("/shelf/mobile_moon_final_sw_work/parts/one.md", True),
        ("/shelf/pre s8/moon_final_en.md", True),
        ("/shelf/写作中转/moon.md", True),
        ("/shelf/do-not_publish/moon.md", True),
        ("D:\\shelf\\Old\\moon.md", True),
        ("/shelf/.reasonix/moon.md", True),
        ("/shelf/mobile_moon_final_en.md", False),
        ("/shelf/moon_final_sw.md", False),
        ("/shelf/workbook/moon.md", False),
        ("/marigold/moon.md", False),
    ],
    audit.excluded_path,
)
of_column(
    "manuscript_scores",
    "int",
    [
        ("/shelf/archive-1/mobile_moon_final_en.md", None),
        ("/shelf/moon_en_draft.md", None),
        ("/shelf/en_full-review.txt", None),
        ("/shelf/mobile_moon_final_en.md", 205),
        ("/shelf/moon_final_sw.txt", 100),
        ("/shelf/moon_sw_final.md", 105),
        ("/shelf/full_story.txt", 20),
        ("/shelf/chapter_9.md", 10),
        ("/shelf/moon.md", 5),
        ("/shelf/moon.pdf", None),
        ("/shelf/moon_synopsis.md", None),
    ],
    audit.manuscript_score,
)


@listed(
    "cover_scores",
    {"path": "string", "en": "int", "sw": "int"},
    [
        ("x/cover_en.jpg", 85, -65),
        ("x/cover.png", 30, 30),
        ("x/kiswahili-cover.webp", 30, 80),
        ("x/english.jpeg", 55, 5),
        ("x/book_sw.png", -100, 50),
        ("x/promo_cover.jpg", None, None),
        ("x/cover.gif", None, None),
        ("x/contact-sheet.png", None, None),
    ],
)
def cover_scores(spark, d):
    paths = ["x/cover_en.jpg", "x/cover.png", "x/kiswahili-cover.webp", "x/english.jpeg", "x/book_sw.png", "x/promo_cover.jpg", "x/cover.gif", "x/contact-sheet.png"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.select("path", *[audit.cover_score(F.col("path"), code).cast("int").alias(code) for code in ("en", "sw")])


@listed("best_covers", {"folder": "string", "language": "string", "path": "string"}, [("a", "en", "a/cover_en.jpg"), ("a", "sw", "a/cover_sw.png"), ("b", "en", "b/cover.png"), ("b", "sw", "b/cover.png")])
def best_covers(spark, d):
    files = [("a", "a/cover_en.jpg"), ("a", "a/cover_sw.png"), ("a", "a/other.jpg"), ("b", "b/cover.png"), ("b", "b/poster.png"), ("c", "c/notes.md")]
    return audit.best_covers(spark.createDataFrame(files, "folder string, path string")).select("folder", "language", "path")



# --- events

_B, _C, _A = "5b0c6f0a-7d1e-4c33-9a55-0f1e2d3c4b5a", "6c1d7e2b-8e2f-1d44-8b66-1a2b3c4d5e6f", "7d2e8f3c-9f30-5e55-ab77-2b3c4d5e6f70"


def _body(event="chapter_start", book=f'"{_B}"', chapter=f'"{_C}"', reader=f'"{_A}"', more=""):
    return f'{{"eventType":"{event}","bookId":{book},"chapterId":{chapter},"anonymousId":{reader}{more}}}'


_REQUESTS = [
    (1, _body(), None, None),
    (2, _body(book='"some-book"'), None, "invalid event"),
    (3, _body("page_turn"), None, "invalid event"),
    (4, _body("chapter_25"), None, None),
    (5, _body("chapter_50"), None, None),
    (6, _body("chapter_75"), None, None),
    (7, _body("chapter_progress"), None, "invalid event"),
    (8, _body("share", chapter="null"), None, "invalid event"),
    (9, _body("book_view", chapter="null"), None, None),
    (10, _body("bookshelf_add", chapter='""'), None, None),
    (11, _body("offline_download", chapter="null"), None, "invalid event"),
    (12, _body(chapter='"x"'), None, "invalid event"),
    (13, _body(reader='"no-id"'), None, "invalid reader"),
    (14, _body(reader='"no-id"'), "user", None),
    (15, _body(more=',"readingSeconds":0'), None, None),
    (16, _body(more=',"readingSeconds":86400'), None, None),
    (17, _body(more=',"readingSeconds":86401'), None, "invalid event"),
    (18, _body(more=',"readingSeconds":1.5'), None, "invalid event"),
    (19, _body(more=',"readingSeconds":"5"'), None, "invalid event"),
    (20, _body(more=',"readingSeconds":-1'), None, "invalid event"),
    (21, _body(more=',"readingSeconds":null'), None, None),
    (22, "[1]", None, "invalid event"),
    (23, "{", None, "not JSON"),
    (24, _body(more=',"pad":"' + "x" * 4096 + '"'), None, "too large"),
    (25, _body(book=f'"{_B.upper()}"', reader=f'" {_A} "'), None, None),
    (26, _body(book='"5b0c6f0a-7d1e-6c33-9a55-0f1e2d3c4b5a"'), None, "invalid event"),
    (27, _body(book='"5b0c6f0a-7d1e-4c33-7a55-0f1e2d3c4b5a"'), None, "invalid event"),
    (28, _body(book="7"), None, "invalid event"),
    (29, _body() + "]", None, "not JSON"),
    (30, _body() + "}", None, "not JSON"),
    (31, _body() + "," + _body(), None, "not JSON"),
    (32, " " + _body() + " ", None, None),
]


@listed("request_outcomes", {"id": "int", "outcome": "string"}, [(k, outcome) for k, _, _, outcome in _REQUESTS])
def request_outcomes(spark, d):
    rows = spark.createDataFrame([r[:3] for r in _REQUESTS], "id int, body string, user_id string")
    return events.request_outcomes(rows).select("id", "outcome")


@listed("scroll_shares", {"k": "int", "percent": "int"}, [(0, 0), (1, 47), (2, 100), (3, 100), (4, 0), (5, 1)])
def scroll_shares(spark, d):
    rows = spark.createDataFrame([(0, 0.0, 900.0), (1, 423.0, 900.0), (2, 990.0, 900.0), (3, 5.0, 0.0), (4, -7.0, 900.0), (5, 4.5, 900.0)], "k int, y double, reach double")
    return rows.select("k", events.scroll_percent(F.col("y"), F.col("reach")).alias("percent"))


# --- audits


@listed(
    "release_checks",
    {"slug": "string", "message": "string"},
    [
        ("none", "missing"),
        ("all", "title mismatch"),
        ("all", "author mismatch"),
        ("all", "language mismatch"),
        ("all", "category mismatch"),
        ("all", "status is draft, expected published"),
        ("all", "total_chapters is 2, expected 3"),
        ("all", "chapter rows are 1, expected 3"),
        ("all", "published chapter rows are 0, expected 3"),
        ("all", "description mismatch"),
        ("all", "tags mismatch"),
        ("all", "translation pairing mismatch"),
        ("all", "cover_url is missing"),
        ("all", "uploaded cover is not versioned"),
        ("plain", "uploaded cover is not versioned"),
    ],
)
def release_checks(spark, d):
    expected = "slug string, title string, author string, language string, category string, status string, chapters long, description_length int, tags array<string>, cover_uploaded boolean, translation_of_slug string"
    actual = "slug string, title string, author_name string, language_code string, category string, status string, total_chapters long, actual_chapters long, published_chapters long, description string, tags array<string>, cover_url string, parent_slug string"
    want = [(slug, "T", "A", "en", "Romance", "published", 3, 5, ["One", "two"], True, None) for slug in ("same", "all", "none", "plain")]
    have = [
        ("same", "T", "A", "en", "Romance", "published", 3, 3, 3, "12345", ["TWO", "one"], "https://x/c.png?v=12", None),
        ("all", "U", "B", "sw", "Thriller", "draft", 2, 1, 0, "1234", ["one"], None, "other"),
        ("plain", "T", "A", "en", "Romance", "published", 3, 3, 3, "12345", ["one", "two"], "https://x/c.png", None),
    ]
    return audit.release_drift(spark.createDataFrame(want, expected), spark.createDataFrame(have, actual))


@listed("environment_lines", {"key": "string", "value": "string"}, [("A", "2"), ("B", "x = y"), ("C", ""), ("D", " kept "), ("E", "it's")])
def environment_lines(spark, d):
    lines = ["# note", "A=1", "B = x = y", "", "C=", 'D=" kept "', "no value", "export E=it's", "A='2'", "1X=3"]
    return audit.environment(spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "position int, line string"))


@listed("response_states", {"slug": "string", "state": "string", "found": "int"}, [("a", "ok", 2), ("b", "http-404", 0), ("c", "error", 0), ("d", "ok", 0), ("e", "http-none", 0)])
def response_states(spark, d):
    rows = [("a", 200, '{"books":[{"slug":"a"},{"slug":"b"}]}', None), ("b", 404, "{}", None), ("c", None, None, "timed out"), ("d", 204, "", None), ("e", None, None, None)]
    return audit.response_rows(spark.createDataFrame(rows, "slug string, status int, body string, error string"))


@listed("retry_waits", {"id": "int", "wait_ms": "long"}, [(1, 500), (2, 1000), (3, 4000), (4, None), (5, 3000), (6, 15000), (7, None), (8, 2000), (9, None)])
def retry_waits(spark, d):
    rows = [(1, 1, 503, None), (2, 2, None, None), (3, 4, 500, None), (4, 5, 503, None), (5, 1, 429, 3), (6, 2, 429, 60), (7, 1, 404, None), (8, 3, 429, None), (9, 1, 200, None)]
    return audit.retry_waits(spark.createDataFrame(rows, "id int, attempt int, status int, retry_after_seconds int")).select("id", "wait_ms")


# --- texts

of_column("slug_latin", "string", [("Café del Mar", "cafe-del-mar"), ("  Ñandú & Õ! ", "nandu-o"), ("e\u0301te\u0301", "ete"), ("---", ""), ("漢字 9", "9")], text.slugify_latin)
of_column("script_safe", "string", [('{"a":"</script>&"}', '{"a":"\\u003c/script\\u003e\\u0026"}'), ("a\u2028b\u2029", "a\\u2028b\\u2029"), ("plain", "plain")], text.script_safe)
of_column("title_case", "string", [("the ÉLAN of don't", "The Élan Of Don'T"), ("sci-fi", "Sci-Fi"), ("", "")], text.title_case)
of_column("dotted_times", "string", [("At 10:30:15 a: b", "At 10.30.15 a: b"), ("1:2", "1.2"), (":3", ":3")], text.dotted_times)
of_column("display_titles", "string", [("Chapter 12: The Gate", "The Gate"), ("Sura ya 3 - Njia", "Njia"), ("sura 4 — Bahari", "Bahari"), ("Chapter 5", "Chapter 5"), ("The Chapter 5: x", "The Chapter 5: x")], text.display_title)
of_column("first_paragraph", "string", [("One  two\nthree\n\nfour", "One two three"), ("", ""), ("x" * 400, "x" * 320)], text.summary)
of_column("detail_synopsis", "string", [("# A\n## Version A\nx\n## Version B long\n> one\n\n---\n two\n## Next\nz", "one\n\ntwo"), ("## Toleo B\nmoja", "moja"), ("none", "")], text.detail_synopsis)
of_column("plain_markup", "string", [("## Title\nbody\n### x", "Title\nbody\nx"), ("#not", "#not")], text.strip_markup)
of_column("words_in_thousands", "string", [("2500", "3k words"), ("499", "0k words"), ("12345", "12k words")], lambda c: text.thousands(c.cast("int")))
of_column("roman_numerals", "string", [("1", "I"), ("4", "IV"), ("1994", "MCMXCIV"), ("3999", "MMMCMXCIX"), ("0", None)], lambda c: codes.roman(c.cast("int")))
of_column("rolling_hashes", "long", [("", 0), ("a", 97), ("ab", 3105), ("a-slug-with-a-key", 1689152034), ("hello", 99162322)], codes.rolling_hash)
of_column("masked_texts", "string", [("", ""), ("Habari", "Habari"), ("é漢 +", "é漢 +")], lambda c: codes.unmasked(codes.masked(c, F.lit(77)), F.lit(77)))
of_column("category_labels", "string", [("sci_fi", "Sci-Fi"), ("urban-fantasy", "Urban-Fantasy"), ("romance", "Romance")], lambda c: text.title_case(F.replace(c, F.lit("_"), F.lit("-"))))
_ARGS = (240, ".store.example", "/object/public/", "/render/public/")
of_column(
    "cover_addresses",
    "string",
    [
        ("https://a.store.example/object/public/c.png?x=1&v=7", "https://a.store.example/render/public/c.png?v=7&width=240&resize=contain&quality=76"),
        ("https://a.store.example/object/public/c.png", "https://a.store.example/render/public/c.png?width=240&resize=contain&quality=76"),
        ("https://b.example/object/public/c.png", "https://b.example/object/public/c.png"),
        ("", ""),
    ],
    lambda c: text.cover_address(c, *_ARGS),
)
of_column("prompt_sizes", "int", [("x" * 2000, 3 + 2 + 1500 + 2 + 300), ("ab", 3 + 2 + 2 + 2 + 2)], lambda c: F.length(text.prompt("Do:", c, c)))
of_column("first_filled", "string", [("", "fallback"), ("own", "own"), (None, "fallback")], lambda c: ingest.first_filled(c, F.lit(""), F.lit("fallback")))


@listed("missing_metadata", {"id": "int", "missing": "string"}, [(1, ""), (2, "title,cover"), (3, "author,description,language (en or sw)")])
def missing_metadata(spark, d):
    rows = [(1, "T", "A", "D", "c", "en"), (2, " ", "A", "D", None, "sw"), (3, "T", "", None, "c", "fr")]
    frame = spark.createDataFrame(rows, "id int, title string, author string, description string, cover string, language string")
    return frame.select("id", F.array_join(ingest.missing_metadata(*[F.col(c) for c in ("title", "author", "description", "cover", "language")]), ",").alias("missing"))


@listed("classified_titles", {"title": "string", "category": "string", "tags": "string"}, [("Red Moon", "Night", "colour"), ("The Gate", "Door", ""), ("Blue Gate", "Night", "colour,place"), ("Else", "Other", "")])
def classified_titles(spark, d):
    rows = spark.createDataFrame([(t,) for t in ("Red Moon", "The Gate", "Blue Gate", "Else")], "title string")
    found = ingest.classify(F.col("title"), {"Night": ["Red Moon", "Blue Gate"], "Door": ["The Gate", "Blue Gate"]}, "Other", [("colour", "Red|Blue"), ("place", "Blue Gate")])
    return rows.select("title", found["category"].alias("category"), F.array_join(found["tags"], ",").alias("tags"))


@listed("local_chapters", {"id": "int"}, [(1,), (5,)])
def local_chapters(spark, d):
    rows = [(1, 1.0, "x"), (2, 0.0, "x"), (3, 1.5, "x"), (4, 2.0, None), (5, 9007199254740991.0, ""), (6, 9007199254740992.0, "x"), (7, None, "x")]
    return ingest.local_chapters(spark.createDataFrame(rows, "id int, number double, content string")).select("id")


# --- manuscripts


def _documents(spark, sources):
    return spark.createDataFrame(list(enumerate(sources, 1)), "doc_id int, text string")


@listed(
    "text_importer",
    {"doc_id": "int", "number": "int", "title": "string", "content": "string"},
    [(1, 1, "A", "x"), (1, 2, "B", "y"), (2, 1, "Full Story", ""), (3, 1, "Section 1", "one\n\ntwo"), (4, 1, "Chapter 7", "z")],
)
def text_importer(spark, d):
    return manuscripts.plain_chapters(_documents(spark, ["Chapter 1: A\nx\n第二章 B\ny", "", "one\n\ntwo", "skipped\nSURA YA 7\nz"]))


@listed("numbered_importer", {"doc_id": "int", "number": "int", "title": "string", "content": "string"}, [(1, 1, "One", "a\nb"), (1, 2, "Two", "c"), (2, 1, "Chapter 1", ""), (2, 4, "Four", "d")])
def numbered_importer(spark, d):
    return manuscripts.numbered_chapters(_documents(spark, ["1. One\na\nb\n## Chapter 2: Two\nc", "preface\n4) Four\nd"]))


@listed("heading_importer", {"doc_id": "int", "number": "int", "title": "string", "content": "string"}, [(1, 1, "Intro", "Intro"), (1, 2, "Chapter 1", "body"), (1, 3, "Sura ya pili", "mwili"), (2, 1, "Section 1", "a b c")])
def heading_importer(spark, d):
    return manuscripts.heading_parts(_documents(spark, ["Intro\nChapter 1\nbody\nSura ya pili\nmwili", "a b\nc"]))


@listed(
    "described_manuscripts",
    {"doc_id": "int", "language": "string", "title": "string", "author": "string"},
    [(1, "en", "The Red Moon", "Jane W. Doe"), (2, "en", "Red Moon", None), (3, "sw", "Salt Road", "Asha Ali"), (4, None, "X", None)],
)
def described_manuscripts(spark, d):
    rows = [
        (1, "x.md", "---\nx: y\n---\n# THE RED MOON\n## Jane W. Doe\n\n# Chapter 1: A\ntext"),
        (2, "mobile_red_moon_final_en_v2.md", "# Chapter 1: A\nx"),
        (3, "salt_road_sw_TOLEO_LILILOPANULIWA.md", "**Mwandishi: Asha Ali**\n# Sura ya 1: A"),
        (4, "x.md", "# X\n## one two three four five six"),
    ]
    return manuscripts.described(spark.createDataFrame(rows, "doc_id int, name string, text string"))


_LINES = [
    ("# Chapter 1: The Start", 1, "The Start"),
    ("Chapter Two — On", 2, "On"),
    ("## Chapter Twenty-One: Far", 21, "Far"),
    ("Sura ya kumi na mbili: Safari", 12, "Safari"),
    ("## Sura ya Kwanza", 1, "Sura ya 1"),
    ("# Chapter one hundred: C", 100, "C"),
    ("# Chapter 7 Night", 7, "Night"),
]


@listed("chapter_lines", {"doc_id": "int", "number": "int", "title": "string"}, [(k, number, title) for k, (_, number, title) in enumerate(_LINES, 1)])
def chapter_lines(spark, d):
    return manuscripts.marked_chapters(_documents(spark, [f"{line}\nbody" for line, _, _ in [*_LINES, ("Chapter 7 Night", 0, ""), ("# Chapter Zero", 0, "")]])).drop("content")


# --- readers' files


@listed("read_manifests", {"book_id": "int", "numbers": "string", "complete": "boolean"}, [(1, "1,2", True), (4, "1", False)])
def read_manifests(spark, d):
    head = '{"schemaVersion":1,"book":{"slug":"a","totalChapters":2},"chapters":'
    rows = [
        (1, head + '[{"number":2,"url":"/read/a/2"},{"number":1,"url":"/read/a/1"},{"number":1,"url":"/read/a/1"},{"number":3,"url":"/read/b/3"},{"number":0,"url":"/read/a/0"}]}'),
        (2, '{"schemaVersion":2}'),
        (3, "{"),
        (4, head + '[{"number":1,"url":"/read/a/1"}]}'),
    ]
    got = publish.read_manifest(spark.createDataFrame(rows, "book_id int, manifest string"))
    return got.select("book_id", F.array_join(F.transform("chapters", lambda c: c["number"].cast("string")), ",").alias("numbers"), "complete")


@listed("read_chapters", {"id": "int", "title": "string", "paragraphs": "string"}, [(1, "One", "a|b"), (2, "Chapter 2", "x|y"), (3, None, None), (4, None, None), (5, None, None), (6, None, None)])
def read_chapters(spark, d):
    record = lambda slug, number, rest: f'{{"schemaVersion":1,"book":{{"slug":"{slug}"}},"chapter":{{"id":"i","number":{number}{rest}}}}}'
    rows = [
        (1, 1, record("s", 1, ',"title":"One","content":"a b","paragraphs":["a","b"]')),
        (2, 2, record("s", 2, ',"content":"x\\n\\ny"')),
        (3, 3, record("other", 3, ',"content":"x"')),
        (4, 4, record("s", 5, ',"content":"x"')),
        (5, 5, record("s", 5, ',"content":" "')),
        (6, 6, "{"),
    ]
    got = publish.read_chapter(spark.createDataFrame(rows, "id int, number int, record string"), F.lit("s"), F.col("number"))
    return got.select("id", F.col("chapter.title").alias("title"), F.array_join("chapter.paragraphs", "|").alias("paragraphs"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, sf_dir, name):
    make, columns, expected = CASES[name]
    frame = make(spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == sorted(expected, key=str)
