"""Queries on books and chapters: catalogue, ingestion, publishing and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import audit, catalog, ingest, publish

from .stand_ins import BOOK_NOW, BOOKS, CHAPTER_ROWS, CHAPTERS, SENT_ORDER, books, chapter_rows, table

QUERIES, ORACLE_SQL = {}, {}
SHOWN = f"status = 'published' AND (published_at IS NULL OR published_at <= TIMESTAMP '{BOOK_NOW}')"
RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY is_featured DESC, updated_at DESC, id) AS rank FROM books)"


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return keep


def chapters(spark, d):
    return ingest.last_of(chapter_rows(spark, d), ["book_id", "chapter_number"], list(SENT_ORDER)).select("book_id", "chapter_number", "title", "word_count", "status", "published_at")


def tagged(spark, d):
    tags = F.array(F.lit("Serial"), F.when(F.col("id") % 11 == 0, "Completed").otherwise("Ongoing"), F.when(F.col("id") % 13 == 0, "English Classics").otherwise("Modern"))
    return books(spark, d).withColumn("tags", tags)


def ranked_books(spark, d):
    return catalog.ranked(books(spark, d), F.desc("is_featured"), F.desc("updated_at"), F.col("id"))


@query("visible_books", f"WITH {BOOKS} SELECT id, slug, language_code FROM books WHERE {SHOWN} AND language_code = 'en'")
def visible_books(spark, d):
    return catalog.visible_books(books(spark, d), BOOK_NOW, "en").select("id", "slug", "language_code")


@query("visible_chapters", f"WITH {BOOKS}, {CHAPTERS} SELECT book_id, chapter_number, title FROM chapters WHERE {SHOWN} AND book_id IN (SELECT id FROM books WHERE {SHOWN})")
def visible_chapters(spark, d):
    return catalog.visible_chapters(chapters(spark, d), books(spark, d), BOOK_NOW).select("book_id", "chapter_number", "title")


@query("hidden_without_chapters", f"WITH {BOOKS}, {CHAPTERS} SELECT id FROM books b WHERE status = 'published' AND NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = b.id AND c.status = 'published')")
def hidden_without_chapters(spark, d):
    return catalog.without_chapters(books(spark, d), chapters(spark, d)).select("id")


@query("works_grouped", f"WITH {BOOKS} SELECT coalesce(parent_book_id, id) AS root_id, count(*) AS editions, count(DISTINCT language_code) AS languages, min(id) AS first_id FROM books GROUP BY 1")
def works_grouped(spark, d):
    return catalog.works(books(spark, d))


@query("rank_catalogue", f"WITH {BOOKS}, {RANKED} SELECT id, rank FROM ranked")
def rank_catalogue(spark, d):
    return ranked_books(spark, d).select("id", "rank")


@query(
    "localized_pick",
    f"""WITH {BOOKS}, {RANKED}, each AS (
      SELECT coalesce(parent_book_id, id) AS root_id, arg_min(title, rank) FILTER (language_code = 'en') AS en, arg_min(title, rank) FILTER (language_code = 'sw') AS sw,
             arg_min(id, rank) FILTER (language_code = 'sw') AS id, min(rank) AS rank, count(DISTINCT language_code) AS n FROM ranked GROUP BY 1)
    SELECT root_id, id, b.slug, coalesce(en, b.title) AS title, sw AS title_swahili, each.rank, n > 1 AS is_bilingual FROM each JOIN books b USING (id)""",
)
def localized_pick(spark, d):
    return catalog.localized(ranked_books(spark, d), "sw")


LABELLED = """labelled AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'Completed' WHEN parent_book_id IS NOT NULL OR id IN (SELECT parent_book_id FROM books WHERE parent_book_id IS NOT NULL) THEN 'Bilingual'
      WHEN is_featured THEN 'Hot' ELSE 'Free' END AS label, CASE WHEN is_featured THEN 'Featured' ELSE total_chapters || ' chapters' END AS heat,
      parent_book_id IS NOT NULL OR id IN (SELECT parent_book_id FROM books WHERE parent_book_id IS NOT NULL) AS is_bilingual FROM books)"""


@query("book_status_label", f"WITH {BOOKS}, {LABELLED} SELECT id, label, heat, is_bilingual FROM labelled")
def book_status_label(spark, d):
    return catalog.status_label(tagged(spark, d)).select("id", "label", "heat", "is_bilingual")


@query(
    "tab_filters",
    f"""WITH {BOOKS}, {LABELLED} SELECT 'Free Zone' AS tab, count(*) AS n FROM labelled WHERE label IN ('Free', 'Hot', 'Bilingual') UNION ALL
    SELECT 'Completed', count(*) FROM labelled WHERE label = 'Completed' UNION ALL SELECT 'Bilingual', count(*) FROM labelled WHERE is_bilingual UNION ALL SELECT 'All', count(*) FROM labelled""",
)
def tab_filters(spark, d):
    rows = catalog.status_label(tagged(spark, d))
    parts = [catalog.tab(rows, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name in ("Free Zone", "Completed", "Bilingual", "All")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "book_cards",
    f"""WITH {BOOKS}, aged AS (SELECT *, CAST(greatest(0, floor((epoch(TIMESTAMP '1996-06-01') - epoch(updated_at)) / 3600 + 0.5)) AS BIGINT) AS hours FROM books)
    SELECT id, CASE WHEN lower(category) = 'romance' THEN 'orange' WHEN lower(category) = 'thriller' THEN 'purple' WHEN language_code = 'sw' THEN 'teal' ELSE 'green' END AS accent,
    CASE WHEN hours < 1 THEN 'Just now' WHEN hours < 24 THEN hours || 'h ago' WHEN hours < 48 THEN 'Yesterday' ELSE CAST(floor(hours / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS updated FROM aged""",
)
def book_cards(spark, d):
    return books(spark, d).select("id", catalog.accent().alias("accent"), catalog.age_label(F.col("updated_at"), "1996-06-01 00:00:00").alias("updated"))


@query("top3", f"WITH {BOOKS} SELECT id, price FROM books ORDER BY price DESC, id LIMIT 3")
def top3(spark, d):
    return catalog.top(books(spark, d), 3, F.desc("price"), F.col("id")).select("id", "price")


@query("top1_per_group", f"WITH {BOOKS} SELECT category, language_code, id, price FROM books QUALIFY row_number() OVER (PARTITION BY category, language_code ORDER BY price DESC, id) = 1")
def top1_per_group(spark, d):
    return catalog.top_of_each(books(spark, d), ["category", "language_code"], [F.desc("price"), F.col("id")]).select("category", "language_code", "id", "price")


@query("editors_choice", f"WITH {BOOKS} SELECT id FROM books ORDER BY is_featured DESC, id LIMIT 1")
def editors_choice(spark, d):
    return catalog.editors_choice(books(spark, d), "is_featured").select("id")


CONV = "rows AS (SELECT conv_id AS book_id, turn AS chapter_number, text FROM conversations)"


def turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_number"), "text")


@query("chapter_window", f"WITH {CONV} SELECT book_id, chapter_number FROM rows WHERE chapter_number >= 2 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) <= 3")
def chapter_window(spark, d):
    return catalog.chapter_window(turns(spark, d), 2, 3).select("book_id", "chapter_number")


@query(
    "prev_next",
    f"""WITH {CONV} SELECT book_id, chapter_number, lag(chapter_number) OVER w AS previous, lead(chapter_number) OVER w AS next FROM rows WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number)""",
)
def prev_next(spark, d):
    return catalog.neighbours(turns(spark, d), "book_id", "chapter_number")


@query(
    "contiguity_check",
    f"WITH {CHAPTERS} SELECT book_id, count(*) AS n, min(chapter_number) = 1 AND max(chapter_number) = count(*) AND count(DISTINCT chapter_number) = count(*) AS contiguous FROM chapters GROUP BY 1",
)
def contiguity_check(spark, d):
    return catalog.contiguity(chapters(spark, d), "book_id", "chapter_number")


@query("search_header", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')")
def search_header(spark, d):
    return catalog.search(table(spark, d, "part"), " SmalL ", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("search_classics", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', s_name, n_name)), 'a')")
def search_classics(spark, d):
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return catalog.search_joined(named, "A", ["s_name", "n_name"]).select("s_suppkey")


@query(
    "parallel_chapters",
    f"""WITH {BOOKS}, {CHAPTERS}, own AS (SELECT coalesce(parent_book_id, id) AS root_id, language_code, book_id, chapter_number FROM chapters JOIN books ON id = book_id)
    SELECT a.root_id, a.chapter_number, a.language_code, a.book_id, b.language_code AS other_language, b.book_id AS other_book_id
    FROM own a JOIN own b ON a.root_id = b.root_id AND a.chapter_number = b.chapter_number AND a.language_code <> b.language_code""",
)
def parallel_chapters(spark, d):
    return catalog.parallel_chapters(chapters(spark, d), books(spark, d))


# --- ingestion


@query("upsert_last_wins", f"WITH {CHAPTERS} SELECT book_id, chapter_number, word_count, status FROM chapters")
def upsert_last_wins(spark, d):
    return chapters(spark, d).select("book_id", "chapter_number", "word_count", "status")


@query(
    "upsert_snapshot",
    f"""WITH {BOOKS} SELECT id, title || CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN ' (new)' ELSE '' END AS title FROM books WHERE id % 2 = 0 OR id % 3 = 0""",
)
def upsert_snapshot(spark, d):
    rows = books(spark, d).select("id", "title")
    source = rows.where("id % 3 = 0").withColumn("title", F.concat("title", F.when(F.col("id") % 2 == 0, " (new)").otherwise("")))
    return ingest.upsert(rows.where("id % 2 = 0"), source, ["id"])


@query(
    "partial_merge",
    f"WITH {BOOKS} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN id % 2 = 0 THEN 'old' ELSE 'new' END AS note FROM books WHERE id % 2 = 0 OR id % 3 = 0",
)
def partial_merge(spark, d):
    rows = books(spark, d).select("id")
    old = rows.where("id % 2 = 0").select("id", F.lit("old").alias("state"), F.lit("old").alias("note"))
    new = rows.where("id % 3 = 0").select("id", F.lit("new").alias("state"), F.lit("new").alias("note"))
    return ingest.merge_columns(old, new, ["id"], kept=["note"])


@query(
    "stale_children",
    f"""WITH {CHAPTERS} SELECT book_id, chapter_number FROM chapters c WHERE book_id IN (SELECT book_id FROM chapters WHERE status = 'published')
    AND NOT EXISTS (SELECT 1 FROM chapters s WHERE s.status = 'published' AND s.book_id = c.book_id AND s.chapter_number = c.chapter_number)""",
)
def stale_children(spark, d):
    rows = chapters(spark, d).select("book_id", "chapter_number", "status")
    return ingest.stale_children(rows.drop("status"), rows.where("status = 'published'"), "book_id", "chapter_number")


@query(
    "create_update_diff",
    f"""WITH {BOOKS} SELECT id, CASE WHEN id % 2 <> 0 THEN 'create' WHEN id % 3 <> 0 THEN 'removed' WHEN id % 5 = 0 THEN 'update' ELSE 'unchanged' END AS action
    FROM books WHERE id % 2 = 0 OR id % 3 = 0""",
)
def create_update_diff(spark, d):
    rows = books(spark, d).select("id", "title")
    return ingest.changes(rows.where("id % 3 = 0").withColumn("title", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("title"))), rows.where("id % 2 = 0"), "id", "title")


@query("missing_slugs", f"WITH {BOOKS} SELECT 'book-' || o_custkey AS slug FROM orders EXCEPT SELECT slug FROM books")
def missing_slugs(spark, d):
    wanted = table(spark, d, "orders").select(F.concat(F.lit("book-"), F.col("o_custkey").cast("string")).alias("slug"))
    return ingest.delete_by_key(books(spark, d), wanted, "slug")[1]


@query(
    "parent_validation",
    """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey WHEN o_orderkey % 7 = 0 THEN o_orderkey + 100000000 WHEN o_orderkey % 5 = 0 THEN o_orderkey - 2
      ELSE o_orderkey - 1 END END AS parent_book_id, CASE WHEN o_orderkey % 11 = 0 THEN 'en' WHEN o_orderkey % 2 = 1 THEN 'sw' ELSE 'en' END AS language_code FROM orders)
    SELECT c.id, c.parent_book_id, CASE WHEN c.parent_book_id = c.id THEN 'own parent' WHEN p.id IS NULL THEN 'no such parent' WHEN p.parent_book_id IS NOT NULL THEN 'parent is a translation'
    WHEN p.language_code = c.language_code THEN 'same language' END AS error FROM b c LEFT JOIN b p ON p.id = c.parent_book_id WHERE c.parent_book_id IS NOT NULL""",
)
def parent_validation(spark, d):
    k = F.col("o_orderkey")
    parent = F.when(k % 2 == 1, F.when(k % 9 == 0, k).when(k % 7 == 0, k + 100000000).when(k % 5 == 0, k - 2).otherwise(k - 1))
    rows = table(spark, d, "orders").select(k.alias("id"), parent.alias("parent_book_id"), F.when(k % 11 == 0, "en").when(k % 2 == 1, "sw").otherwise("en").alias("language_code"))
    return ingest.parent_errors(rows)


@query(
    "content_version",
    """WITH h AS (SELECT user_id, event_id, ts, event_type, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE CAST(event_type IS DISTINCT FROM lag(event_type) OVER w AS INTEGER) END AS c
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, event_type, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS content_version FROM h""",
)
def content_version(spark, d):
    return ingest.versions(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("batch_guards", f"WITH {BOOKS} SELECT CAST(count(*) AS BIGINT) AS books, 2 * count(*) AS chapters, count(*) - count(DISTINCT category) - count(*) + (SELECT count(*) FROM (SELECT category FROM books GROUP BY 1 HAVING count(*) > 1)) + count(DISTINCT category) AS repeated_slugs, FALSE AS accepted FROM books")
def batch_guards(spark, d):
    rows = books(spark, d).select(F.col("category").alias("slug"), F.array(F.lit(1), F.lit(2)).alias("chapters"))
    return ingest.batch_errors(rows)


@query(
    "book_rules",
    """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN 'Bad Slug' ELSE 'part-' || p_partkey END AS slug, CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE p_name END AS title,
      CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'ftp://x' ELSE 'https://x/y' END AS cover, p_size % 10 AS n, CASE WHEN p_partkey % 3 = 0 THEN 'Romance' ELSE p_brand END AS category FROM part)
    SELECT id, CASE WHEN trim(title) = '' THEN 'needs title, author and language' WHEN slug = 'Bad Slug' THEN 'invalid slug' WHEN cover = 'ftp://x' THEN 'invalid cover address' WHEN cover IS NULL THEN 'needs a cover'
      WHEN n = 0 THEN 'needs between 1 and 800 chapters' WHEN n = 7 THEN 'chapter without title or content, or repeated number' WHEN category <> 'Romance' THEN 'needs a canonical category' END AS error FROM b""",
)
def book_rules(spark, d):
    k = F.col("p_partkey")
    n = F.col("p_size") % 10
    one = lambda i: F.struct(F.when(n == 7, 1).otherwise(i).cast("int").alias("number"), F.lit("t").alias("title"), F.lit("c").alias("content"))
    made = table(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 31 == 0, "Bad Slug").otherwise(F.concat(F.lit("part-"), k.cast("string"))).alias("slug"),
        F.when(k % 29 == 0, " ").otherwise(F.col("p_name")).alias("title"),
        F.lit("a").alias("author"),
        F.lit("en").alias("language"),
        F.when(k % 3 == 0, "Romance").otherwise(F.col("p_brand")).alias("category"),
        F.lit("text").alias("description"),
        F.when(k % 23 == 0, None).when(k % 19 == 0, "ftp://x").otherwise("https://x/y").alias("cover_url"),
        F.array(F.lit("A "), F.lit("a")).alias("tags"),
        F.lit("published").alias("status"),
        F.lit(None).cast("string").alias("translation_of_slug"),
        F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).alias("chapters"),
    )
    return ingest.book_errors(made).select("id", "error")


# --- publishing

SIBLINGS = """siblings AS (SELECT a.id, b.id AS sibling_id, b.slug AS sibling_slug, b.language_code AS sibling_language FROM books a JOIN books b
  ON coalesce(a.parent_book_id, a.id) = coalesce(b.parent_book_id, b.id) AND a.id <> b.id
  UNION SELECT a.id, b.id, b.slug, b.language_code FROM books a JOIN books b ON a.id <> b.id AND b.slug = CASE WHEN a.language_code <> 'sw' THEN a.slug || '-sw' WHEN a.slug LIKE '%-sw' THEN left(a.slug, length(a.slug) - 3) END)"""
SIBLING_CHAPTERS = "sibling_chapters AS (SELECT s.id, c.chapter_number, sibling_id, sibling_slug, sibling_language FROM siblings s JOIN chapters c ON c.book_id = s.id JOIN chapters o ON o.book_id = sibling_id AND o.chapter_number = c.chapter_number)"


@query("sibling_union", f"WITH {BOOKS}, {SIBLINGS} SELECT * FROM siblings")
def sibling_union(spark, d):
    return publish.siblings(books(spark, d))


@query("sibling_chapters", f"WITH {BOOKS}, {CHAPTERS}, {SIBLINGS}, {SIBLING_CHAPTERS} SELECT * FROM sibling_chapters")
def sibling_chapters(spark, d):
    return publish.sibling_chapters(books(spark, d), chapters(spark, d))


@query(
    "hreflang_rows",
    f"""WITH {BOOKS}, {CHAPTERS}, {SIBLINGS}, {SIBLING_CHAPTERS}, own AS (SELECT b.id, chapter_number, language_code AS code, '{publish.SITE}/read/' || slug || '/' || chapter_number AS url FROM chapters JOIN books b ON b.id = book_id),
    others AS (SELECT id, chapter_number, sibling_language AS code, '{publish.SITE}/read/' || sibling_slug || '/' || chapter_number AS url FROM sibling_chapters)
    SELECT * FROM own UNION ALL SELECT * FROM others UNION ALL
    SELECT id, chapter_number, 'x-default', coalesce((SELECT min(url) FROM others o WHERE o.id = own.id AND o.chapter_number = own.chapter_number AND o.code = 'en'), url) FROM own""",
)
def hreflang_rows(spark, d):
    return publish.alternates(books(spark, d), chapters(spark, d))


@query(
    "manifest_entries",
    f"""WITH {BOOKS}, {CHAPTERS}, r AS (SELECT * FROM books JOIN chapters ON id = book_id)
    SELECT book_id, TRUE AS complete, count(*) AS n, min(chapter_number) AS first_number, '{publish.SITE}/read/' || any_value(slug) || '/' || max(chapter_number) AS last_url FROM (SELECT book_id, chapter_number, b.slug FROM chapters JOIN books b ON b.id = book_id) GROUP BY 1""",
)
def manifest_entries(spark, d):
    parsed = publish.read_manifest(publish.manifest(books(spark, d), chapters(spark, d)))
    return parsed.select("book_id", "complete", F.size("chapters").cast("long").alias("n"), F.col("chapters")[0]["number"].alias("first_number"), F.element_at("chapters", -1)["url"].alias("last_url"))


@query(
    "build_changes",
    f"""WITH {BOOKS} SELECT slug, CASE WHEN id % 2 <> 0 THEN 'added' WHEN id % 3 <> 0 THEN 'removed' WHEN id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM books WHERE id % 2 = 0 OR id % 3 = 0""",
)
def build_changes(spark, d):
    rows = books(spark, d).select("id", "slug", "title", "total_chapters")
    now = rows.where("id % 3 = 0").withColumn("title", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("title")))
    return publish.build_changes(publish.content_hash(now, "slug"), publish.content_hash(rows.where("id % 2 = 0"), "slug"))


@query(
    "sitemap",
    f"""WITH {BOOKS}, {CHAPTERS}, {SIBLINGS}, {SIBLING_CHAPTERS}, own AS (SELECT b.id, chapter_number, language_code AS code, '{publish.SITE}/read/' || slug || '/' || chapter_number AS url FROM chapters JOIN books b ON b.id = book_id),
    others AS (SELECT id, chapter_number, sibling_language AS code, '{publish.SITE}/read/' || sibling_slug || '/' || chapter_number AS url FROM sibling_chapters),
    english AS (SELECT id, chapter_number, min(url) AS url FROM others WHERE code = 'en' GROUP BY 1, 2),
    links AS (SELECT * FROM own UNION ALL SELECT * FROM others UNION ALL SELECT id, chapter_number, 'x-default', coalesce(e.url, own.url) FROM own LEFT JOIN english e USING (id, chapter_number)),
    lists AS (SELECT id, chapter_number, array_to_string(list_sort(list(DISTINCT '<xhtml:link rel="alternate" hreflang="' || code || '" href="' || url || '"/>')), '') AS l FROM links GROUP BY 1, 2)
    SELECT id, chapter_number, '<url><loc>' || url || '</loc>' || l || '<lastmod>2000-01-01</lastmod><changefreq>monthly</changefreq><priority>0.6</priority></url>' AS element FROM own JOIN lists USING (id, chapter_number)""",
)
def sitemap(spark, d):
    return publish.page_elements(publish.page_links(books(spark, d), chapters(spark, d)), "2000-01-01")


# --- audits


@query(
    "release_audit_counts",
    f"""WITH {BOOKS}, {CHAPTERS} SELECT b.id, count(c.book_id) AS actual_chapters, count(c.book_id) FILTER (c.status = 'published') AS published_chapters, any_value(p.slug) AS parent_slug
    FROM books b LEFT JOIN chapters c ON c.book_id = b.id LEFT JOIN books p ON p.id = b.parent_book_id GROUP BY b.id""",
)
def release_audit_counts(spark, d):
    return audit.release_counts(books(spark, d), chapters(spark, d)).select("id", "actual_chapters", "published_chapters", "parent_slug")


#: Ways in which every so many books differ from what is expected of them.
DRIFTS = {
    6: "title mismatch",
    7: "author mismatch",
    8: "language mismatch",
    9: "category mismatch",
    10: "status is gone, expected ' || status || '",
    11: "total_chapters is ' || (total_chapters + 1) || ', expected ' || total_chapters || '",
    12: "chapter rows are ' || (total_chapters + 1) || ', expected ' || total_chapters || '",
    13: "published chapter rows are none, expected ' || total_chapters || '",
    14: "description mismatch",
    16: "tags mismatch",
    17: "translation pairing mismatch",
    18: "cover_url is missing",
}


@query(
    "drift_report",
    f"WITH {BOOKS}, a AS (SELECT * FROM books WHERE id % 15 <> 0) SELECT slug, 'missing' AS message FROM books WHERE id % 15 = 0 "
    + " ".join(f"UNION ALL SELECT slug, '{message}' FROM a WHERE id % {n} = 0" for n, message in DRIFTS.items())
    + " UNION ALL SELECT slug, 'uploaded cover is not versioned' FROM a WHERE id % 2 = 0 AND (id % 18 = 0 OR id % 19 = 0)",
)
def drift_report(spark, d):
    k = F.col("id")
    tags = lambda *names: F.array(*map(F.lit, names))
    rows = books(spark, d)
    expected = rows.select(
        "slug", "title", F.col("author_name").alias("author"), F.col("language_code").alias("language"), "category", "status", F.col("total_chapters").alias("chapters"), F.lit(5).alias("description_length"), tags("One", "two").alias("tags"), (k % 2 == 0).alias("cover_uploaded"), F.lit(None).cast("string").alias("translation_of_slug")
    )
    other = lambda n, c, value: F.when(k % n == 0, value).otherwise(F.col(c))
    n = F.col("total_chapters")
    actual = rows.where("id % 15 <> 0").select(
        "slug", other(6, "title", "other").alias("title"), other(7, "author_name", "other").alias("author_name"), other(8, "language_code", "fr").alias("language_code"), other(9, "category", None).alias("category"), other(10, "status", "gone").alias("status"),
        other(11, "total_chapters", n + 1).alias("total_chapters"), other(12, "total_chapters", n + 1).alias("actual_chapters"), other(13, "total_chapters", None).alias("published_chapters"), F.when(k % 14 == 0, "four").otherwise("fives").alias("description"),
        F.when(k % 16 == 0, tags("one")).otherwise(tags("TWO", "One")).alias("tags"), F.when(k % 18 == 0, None).when(k % 19 == 0, "u?version=1").otherwise("u?x=2&v=1").alias("cover_url"), F.when(k % 17 == 0, "p").alias("parent_slug"),
    )
    return audit.release_drift(expected, actual)


@query(
    "asset_limits",
    """SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(struct_pack(b := strlen(text), p := 'doc/' || doc_id)).p AS largest_path, CAST(max(strlen(text)) AS INTEGER) AS largest_bytes,
    count(*) FILTER (strlen(text) > 20000) AS oversized, count(*) <= 20000 AND count(*) FILTER (strlen(text) > 20000) = 0 AS within_limits FROM documents""",
)
def asset_limits(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("bytes"))
    return audit.asset_totals(files, max_bytes=20000)


@query("assets_left_count", "SELECT c_custkey, count(o_orderkey) AS assets FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def assets_left_count(spark, d):
    return audit.count_children(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "assets")


@query("rows_per_table", "SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def rows_per_table(spark, d):
    return audit.table_counts({name: table(spark, d, name) for name in ("nation", "orders", "region")})


@query("repeated_keys", f"WITH {CHAPTER_ROWS} SELECT book_id, chapter_number, count(*) AS n FROM chapter_rows GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return audit.repeated(chapter_rows(spark, d), ["book_id", "chapter_number"])


@query(
    "source_choice",
    """WITH f AS (SELECT o_custkey AS folder, o_orderkey % 2 AS language, 'p/' || CASE o_orderkey % 5 WHEN 0 THEN 'mobile_x_final_en' WHEN 1 THEN 'story_draft' WHEN 2 THEN 'full_story' WHEN 3 THEN 'final' ELSE 'notes' END || '_' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.md' ELSE '.txt' END AS path, o_orderkey FROM orders)
    SELECT folder, language, path FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 2 THEN 20 WHEN 3 THEN 50 END + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS score FROM f) WHERE score IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY folder, language ORDER BY score DESC, path) = 1""",
)
def source_choice(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "mobile_x_final_en").when(k % 5 == 1, "story_draft").when(k % 5 == 2, "full_story").when(k % 5 == 3, "final").otherwise("notes")
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), (k % 2).alias("language"), F.concat(F.lit("p/"), name, F.lit("_"), k.cast("string"), F.when(k % 3 == 0, ".md").otherwise(".txt")).alias("path"))
    return audit.best_sources(files).select("folder", "language", "path")
