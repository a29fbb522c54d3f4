"""Operators on small tables: nulls, ties, empty tables and the rules' order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import audit, catalog, formatting, ingest, publish
from folioloom.operators import events as ev

NBSP, BOM = "\u00a0", "\ufeff"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_white_space_and_counts(spark):
    odd = F.lit(f"{BOM}\t a{NBSP}b\u2028c \r\n")
    assert one(spark, text.js_trim(odd)) == f"a{NBSP}b\u2028c"
    assert one(spark, text.word_count(odd)) == 3
    assert [one(spark, f(F.lit(""))) for f in (text.word_count, text.split_count, text.token_count, text.translation_units)] == [0, 1, 0, 1]
    assert one(spark, text.token_count(F.lit("it's well-known, isn’t it? 'quoted'"))) == 5
    assert one(spark, text.payload(odd)) == "abc"
    assert one(spark, text.stored_word_count(F.lit(-1), F.lit("a b"))) == 2


def test_slugs_tags_categories(spark):
    assert one(spark, text.slugify(F.lit("  Hello, World! -- 2nd "))) == "hello-world-2nd"
    assert one(spark, text.slugify_latin(F.lit("Élan naïve"))) == "elan-naive"
    assert one(spark, text.normalize_tags(F.array(*[F.lit(x) for x in (" A  b", "a B", "", "C")]))) == ["A b", "C"]
    assert [one(spark, text.normalize_category(F.lit(x))) for x in ("sci_fi", "SCIENCE FICTION", "urban  fantasy", "x", " ")] == ["Sci-Fi", "Sci-Fi", "Urban Fantasy", "", ""]


def test_markup(spark):
    assert one(spark, text.html_escape(F.lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"
    assert one(spark, text.script_safe(F.lit("</script>\u2028&"))) == "\\u003c/script\\u003e\\u2028\\u0026"
    assert one(spark, text.html_text(F.lit("<p>a</p><script>b</script><!-- c --><b>d&amp;e"))) == "a d&e"
    assert one(spark, text.display_title(F.lit("Chapter 3: The End"))) == "The End"
    assert one(spark, text.uri_component(F.lit("a b/é~"))) == "a%20b%2F%C3%A9~"
    assert one(spark, text.ngrams(F.array(F.lit("a"), F.lit("b")), 12)) == ["a", "b", "a b"]
    assert one(spark, text.ngrams(F.array().cast("array<string>"))) == []
    kinds = {"* * *": "scene_break", "Chapter One": "heading", "Dear Sir,": "letter", "1. item": "list", "short line\nand another": "poetry", "One long line of prose.": "prose"}
    assert {k: one(spark, text.block_kind(F.lit(k))) for k in kinds} == kinds


def test_segments(spark):
    paragraphs = F.array(F.lit("a"), F.lit("b"))
    marked = one(spark, formatting.mark_segments(paragraphs))
    assert marked == "[[NT_SEG:0001]]\na\n\n[[NT_SEG:0002]]\nb"
    assert one(spark, formatting.unmark_segments(F.lit("junk" + marked))) == "a\n\nb"
    assert one(spark, formatting.segments_valid(F.lit(marked), F.lit(2))) and not one(spark, formatting.segments_valid(F.lit(marked), F.lit(3)))


def test_admission_boundaries(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(seconds=s), None, "a") for k, s in enumerate([0, 0, 60, 61, 120, 121])]
    frame = spark.createDataFrame(rows, "event_id long, created_at timestamp, user_id string, anonymous_id string")
    got = {r.event_id: r.accepted for r in ev.admit(frame, quota=2, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
    assert ev.admit(frame.limit(0)).count() == 0
    assert ev.recent_counts(frame, 60).orderBy("event_id").select("recent").collect()[2][0] == 3


def test_null_actors(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 5), None, None, "x", None), (dt.datetime(2024, 1, 6), "u", "", "x", None), (dt.datetime(2024, 2, 1), None, "", "x", 3)], "created_at timestamp, user_id string, anonymous_id string, event_type string, book_id long")
    assert sorted((r.event_count, r.unique_readers) for r in ev.rollup(frame).collect()) == [(1, 1), (2, 1)]
    assert {r.readers for r in ev.readers_per_day(frame).collect()} == {0, 1}


def test_upserts(spark):
    sent = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, None)], "k int, at int, v string")
    last = ingest.last_of(sent, ["k"], ["at"])
    assert sorted(map(tuple, last.collect())) == [(1, 2, "new"), (2, 1, None)]
    target = spark.createDataFrame([(1, 0, "was"), (3, 0, "stays")], "k int, at int, v string")
    assert sorted(map(tuple, ingest.upsert(target, last, ["k"]).collect()), key=str) == [(1, 2, "new"), (2, 1, None), (3, 0, "stays")]
    assert ingest.all_or_nothing(sent.withColumn("error", F.when(F.col("k") == 2, "bad"))).count() == 0
    assert ingest.all_or_nothing(sent.withColumn("error", F.lit(None).cast("string"))).count() == 3


CHAPTERS = "array<struct<number:int,title:string,content:string>>"


def test_rules_in_order(spark):
    schema = f"slug string, title string, author string, language string, category string, description string, cover_url string, tags array<string>, status string, translation_of_slug string, chapters {CHAPTERS}"
    good = ["a-b", "T", "A", "en", "Romance", "d", "/covers/x", ["t"], "published", None, [(1, "t", "c")]]
    cases = [({}, None), ({1: " "}, "needs title, author and language"), ({3: None}, "needs title, author and language"), ({0: "A_b"}, "invalid slug"), ({6: "http://x"}, "invalid cover address"), ({6: None}, "needs a cover"), ({5: ""}, "needs a description"), ({10: None}, "needs between 1 and 800 chapters"), ({10: [(1, "t", "c"), (1, "u", "c")]}, "chapter without title or content, or repeated number"), ({10: [(0, "t", "c")]}, "chapter without title or content, or repeated number"), ({4: None}, "needs a canonical category"), ({7: None}, "needs a tag"), ({7: ["x" * 41]}, "too many or too long tags"), ({9: "a-b"}, "translation of itself"), ({4: "Other", 8: "draft"}, None)]
    rows = [[change.get(k, v) for k, v in enumerate(good)] for change, _ in cases]
    checked = ingest.book_errors(spark.createDataFrame(rows, schema)).select("error").collect()
    assert [r[0] for r in checked] == [e for _, e in cases]


def test_suspicious_chapters(spark):
    check = lambda t, c: one(spark, ingest.suspiciously_short(F.lit(t), F.lit(c)))
    assert check("Contents.", "a b") and check("IV", "[1] [2] [3]") and check("12", "page 1, 2, 3")
    assert not check("IV", "No.") and not check("Contents", "word " * 100)


def test_drift_and_counts(spark):
    expected = spark.createDataFrame([("a", "T", ["x", "Y"]), ("b", None, None)], "slug string, title string, tags array<string>")
    actual = spark.createDataFrame([("a", "U", ["y", "X"]), ("c", None, None)], "slug string, title string, tags array<string>")
    assert sorted(map(tuple, audit.drift(expected, actual, ["title"], "tags").collect())) == [("a", "title mismatch"), ("b", "missing")]
    assert audit.asset_totals(spark.createDataFrame([], "path string, bytes long")).first().within_limits
    scores = {p: one(spark, audit.manuscript_score(F.lit(p))) for p in ("x/mobile_a_final_en.md", "x/archive/a.md", "x/a_draft.md", "a.txt", "a.pdf", "notes.md")}
    assert scores == {"x/mobile_a_final_en.md": 205, "x/archive/a.md": None, "x/a_draft.md": None, "a.txt": 0, "a.pdf": None, "notes.md": None}


def test_manifests(spark):
    rows = spark.createDataFrame([(1, '{"schemaVersion":1,"book":{"slug":"a","totalChapters":2},"chapters":[{"number":2,"url":"/read/a/2"},{"number":1,"url":"/read/a/1"},{"number":1,"url":"/read/a/1"},{"number":3,"url":"/read/b/3"}]}'), (2, '{"schemaVersion":2}'), (3, "{")], "book_id int, manifest string")
    got = publish.read_manifest(rows)
    assert [(r.book_id, [c.number for c in r.chapters], r.complete) for r in got.collect()] == [(1, [1, 2], True)]
    saved = spark.createDataFrame([(1, 1), (1, 9), (2, 9)], "book_id int, chapter_number int")
    assert [tuple(r) for r in publish.reconcile(saved, got).collect()] == [(1, 9)]


def test_ranks_and_hero(spark):
    books = spark.createDataFrame([(k, "en", k % 3 == 0, "Romance", ["x"], "c" if k > 4 else None) for k in range(100)], "id int, language_code string, is_featured boolean, category string, tags array<string>, cover_url string")
    got = {r.id: r["rank"] for r in catalog.ranked(books, F.desc("is_featured"), F.col("id")).collect()}
    order = sorted(range(100), key=lambda k: (k % 3 != 0, k))
    assert got == {k: i + 1 for i, k in enumerate(order)}
    assert catalog.hero(books).first().id == 6 and catalog.editors_choice(books, "is_featured").first().id == 0
    assert catalog.search(books, " ROM ", ["category"]).count() == 100 and catalog.search(books, "zzz", ["category"]).count() == 0
    assert one(spark, F.size(publish.middle_insert(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string")), F.lit("ad")))) == 21


def test_codes(spark):
    from folioloom.functions import codes

    assert [one(spark, codes.roman(F.lit(n))) for n in (1, 4, 1994, 3999, 0)] == ["I", "IV", "MCMXCIV", "MMMCMXCIX", None]
    h = 0
    for c in "a-slug-with-a-key":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert one(spark, codes.rolling_hash(F.lit("a-slug-with-a-key"))) == abs(h)
    for plain in ("", "Habari + dunia: é\n漢", "x" * 500):
        hidden = one(spark, codes.masked(F.lit(plain), F.lit(77)))
        assert one(spark, codes.unmasked(F.lit(hidden), F.lit(77))) == plain
    assert one(spark, codes.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) and not one(spark, codes.is_uuid(F.lit("x")))


def test_further_text(spark):
    assert one(spark, text.title_case(F.lit("the ÉLAN of don't-stop 3rd"))) == "The Élan Of Don'T-Stop 3rd"
    assert one(spark, text.dotted_times(F.lit("At 10:30:15 a: b"))) == "At 10.30.15 a: b"
    source = "# A\n## Version A\nx\n## Version B long\n> one\n\n---\n two\n## Next\nz"
    assert one(spark, text.detail_synopsis(F.lit(source))) == "one\n\ntwo" and one(spark, text.detail_synopsis(F.lit("none"))) == ""
    assert one(spark, text.thousands(F.lit(2500))) == "3k words"
    args = (240, ".store.example", "/object/public/", "/render/public/")
    assert one(spark, text.cover_address(F.lit("https://a.store.example/object/public/c.png?x=1&v=7"), *args)) == "https://a.store.example/render/public/c.png?v=7&width=240&resize=contain&quality=76"
    assert one(spark, text.cover_address(F.lit("https://b.example/object/public/c.png"), *args)) == "https://b.example/object/public/c.png"


def test_transfers_and_matches(spark):
    files = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1)], "path string, bytes long")
    have = spark.createDataFrame([("a", 109), ("b", 110)], "path string, bytes long")
    assert sorted(r.path for r in audit.to_transfer(files, have).collect()) == ["b", "c"]
    slugs = spark.createDataFrame([("red-moon",), ("red-moon-sw",), ("sun",)], "slug string")
    ids = spark.createDataFrame([("2026-01-01_red_moon",), ("2026-01-01_red",)], "book_id string")
    assert sorted(map(tuple, audit.match_ids(slugs, ids).collect())) == [("red-moon", "2026-01-01_red"), ("red-moon-sw", "2026-01-01_red"), ("sun", None)]
    assert {r.book_id for r in audit.match_ids(slugs, ids.limit(0)).collect()} == {None}
    left = spark.createDataFrame([(1, "ab c"), (2, "x")], "k int, t string")
    right = spark.createDataFrame([(1, "c\nba"), (2, "y")], "k int, t string")
    assert {r.k: r.same for r in audit.same_characters(left, right, "k", "t").collect()} == {1: True, 2: False}


def test_patches(spark):
    books = spark.createDataFrame([(1, "T", None, "d", "draft", None), (2, "U", "/covers/u", "d", "draft", None), (3, "V", None, None, "draft", None)], "id int, title string, cover_url string, description string, status string, published_at timestamp")
    patches = spark.createDataFrame([(1, {"status": "published", "title": "X"}), (2, {"status": "published", "id": "9"}), (3, {"title": "W"})], "id int, changes map<string,string>")
    got = {r.id: r for r in ingest.patch(books, patches, "2024-01-01 00:00:00").collect()}
    assert (got[1].title, got[1].status, got[1].error) == ("T", "draft", "add a cover before publishing")
    assert got[2].status == "published" and got[2].published_at == dt.datetime(2024, 1, 1) and got[2].error is None
    assert got[3].title == "W" and got[3].status == "draft"
    made = ingest.classify(F.lit("Dracula"), {"Romance": ["Emma"], "Thriller": ["Dracula", "Emma"]}, "Historical", [("Detective", "Holmes"), ("Night", "Drac")])
    assert tuple(one(spark, made)) == ("Thriller", ["Night"])


def test_report_and_throttle(spark):
    rows = spark.createDataFrame([("<A>", "book_view", 1234, 5)], "book_title string, event_type string, event_count long, unique_readers long")
    assert ev.report_rows(rows).first()[0] == "<tr><td>&lt;A&gt;</td><td>book_view</td><td>1,234</td><td>5</td></tr>"
    at = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(k, at + dt.timedelta(seconds=s), "u", None) for k, s in enumerate([0, 5, 13, 20])], "event_id long, created_at timestamp, user_id string, anonymous_id string")
    assert sorted(r.event_id for r in ev.throttled(frame).collect()) == [0, 2]


def test_snapshots_and_builds(spark, tmp_path):
    hashes = spark.createDataFrame([("a", "1"), ("b", "2")], "slug string, content_hash string")
    publish.write_build(hashes, f"{tmp_path}/build", 3, "code")
    before = spark.read.json(f"{tmp_path}/build")
    assert {tuple(r) for r in publish.rebuild(hashes, before, "code").collect()} == {("a", "unchanged"), ("b", "unchanged")}
    assert {r.state for r in publish.rebuild(hashes, before, "other").collect()} == {"changed"}
    publish.write_snapshot(hashes, f"{tmp_path}/catalogue")
    assert spark.read.json(f"{tmp_path}/catalogue").count() == 2
    index = publish.sitemap_index("2000-01-01")
    assert index.count("<sitemap>") == 4 and "sitemap-books-sw.xml" in index
    assert publish.robots(["SomeBot"], ["/admin/"]).split("\n")[:3] == ["User-agent: *", "Allow: /", "Disallow: /admin/"]


def test_guards(spark):
    books = spark.createDataFrame([(1, "a"), (2, "b")], "id int, slug string")
    for slugs, said in (([], None), (["Not a slug"], None), ([f"s{k}" for k in range(51)], None), ([], "delete all books")):
        with pytest.raises(ValueError):
            ingest.guarded_delete(books, slugs, said)
    stay, gone, missing = ingest.guarded_delete(books, ["a", "c"])
    assert [[r.slug for r in part.collect()] for part in (stay, gone, missing)] == [["b"], ["a"], ["c"]]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from folioloom.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.root(Cluster())
