"""Queries on imports, publishing and audits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import audit, catalog, ingest, publish
from folioloom.streaming import events as stream

from .book_queries import chapters, tagged
from .stand_ins import BOOKS, CHAPTERS, books, table

QUERIES, ORACLE_SQL = {}, {}
NOW = "2000-01-01 00:00:00"
SITE = publish.SITE


def query(name: str, sql: str):
    def keep(make):
        QUERIES[name] = make
        ORACLE_SQL[name] = sql
        return make

    return keep


# --- catalogue

COVERED = "covered AS (SELECT *, CASE WHEN id % 4 = 2 THEN NULL WHEN id % 6 = 0 THEN '' ELSE 'c' || id END AS cover_url, id % 13 = 0 AS classic FROM books)"


def covered(spark, d):
    k = F.col("id")
    return tagged(spark, d).withColumn("cover_url", F.when(k % 4 == 2, None).when(k % 6 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))))


@query("hero_pick", f"WITH {BOOKS}, {COVERED} SELECT id FROM covered WHERE language_code = 'en' AND NOT classic AND coalesce(cover_url, '') <> '' ORDER BY is_featured DESC, updated_at DESC, id LIMIT 1")
def hero_pick(spark, d):
    return catalog.hero(covered(spark, d), F.desc("updated_at"), F.col("id")).select("id")


@query("hero_unfeatured", f"WITH {BOOKS}, {COVERED} SELECT id FROM covered WHERE NOT is_featured AND language_code = 'en' AND NOT classic AND coalesce(cover_url, '') <> '' ORDER BY id LIMIT 1")
def hero_unfeatured(spark, d):
    return catalog.hero(covered(spark, d).where("not is_featured")).select("id")


@query("flagged_choice", f"WITH {BOOKS} SELECT (SELECT id FROM books ORDER BY is_featured DESC, id LIMIT 1) AS flagged, (SELECT min(id) FROM books) AS first")
def flagged_choice(spark, d):
    rows = books(spark, d)
    flagged = catalog.editors_choice(rows, "is_featured").select(F.col("id").alias("flagged"))
    return flagged.join(catalog.editors_choice(rows.withColumn("none", F.lit(None).cast("boolean")), "none").select(F.col("id").alias("first")))


@query(
    "search_states",
    "WITH p AS (SELECT p_type AS category, contains(lower(concat_ws(' ', p_name, p_brand)), 'red') AS red FROM part) SELECT 'SMALL' AS category, count(*) FILTER (red) AS matches, count(*) FILTER (red AND category = 'SMALL') AS shown, FALSE AS only_elsewhere FROM p UNION ALL SELECT 'none', count(*) FILTER (red), 0, count(*) FILTER (red) > 0 FROM p UNION ALL SELECT 'All', count(*) FILTER (red), count(*) FILTER (red), FALSE FROM p",
)
def search_states(spark, d):
    rows = table(spark, d, "part").withColumnRenamed("p_type", "category")
    parts = [catalog.search_state(rows, " RED ", ["p_name", "p_brand"], name).select(F.lit(name).alias("category"), "*") for name in ("SMALL", "none", "All")]
    return parts[0].union(parts[1]).union(parts[2])


@query("owned_rows", "SELECT o_orderkey, 'reader' AS seen_by FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey, 'admin' FROM orders")
def owned_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("user_id"))
    mine, all_rows, none = catalog.owned(rows, "7"), catalog.owned(rows, "7", "admin"), catalog.owned(rows, None)
    said = lambda part, who: part.select("o_orderkey", F.lit(who).alias("seen_by"))
    return said(mine, "reader").union(said(all_rows, "admin")).union(said(none, "nobody"))


@query("new_profiles", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 2 = 0 THEN c_name ELSE 'c' || c_custkey || '@example.org' END AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'editor' ELSE 'reader' END AS role FROM customer")
def new_profiles(spark, d):
    k = F.col("c_custkey")
    users = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("full_name"), F.concat(F.lit("c"), k.cast("string"), F.lit("@example.org")).alias("email"))
    return catalog.new_profiles(users, users.where("id % 3 = 0").select("id", F.lit("kept").alias("display_name"), F.lit("editor").alias("role")))


@query("shelf_books", f"WITH {BOOKS} SELECT o_custkey AS reader, id, slug FROM orders JOIN books ON id = o_orderkey * 3")
def shelf_books(spark, d):
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("reader"), (F.col("o_orderkey") * 3).alias("book_id"))
    return catalog.shelf(entries, books(spark, d)).select("reader", "id", "slug")


# --- imports

#: A batch of every third book; originals of those whose id is not a multiple of 9 are known beforehand, some are missing.
BATCH = """batch AS (SELECT id, slug, language_code AS language, CASE WHEN id % 21 = 0 THEN 'no-such' WHEN id % 15 = 0 THEN slug WHEN id % 33 = 0 THEN 'book-6-sw' WHEN id % 2 = 1 THEN 'book-' || (id - 1) WHEN id % 12 = 0 THEN '' END AS translation_of_slug FROM books WHERE id % 3 = 0),
  known AS (SELECT id, slug, language_code FROM books WHERE id % 3 <> 0 AND id % 9 <> 2)"""


def batch_rows(spark, d):
    k = F.col("id")
    of = F.when(k % 21 == 0, "no-such").when(k % 15 == 0, F.col("slug")).when(k % 33 == 0, "book-6-sw").when(k % 2 == 1, F.concat(F.lit("book-"), (k - 1).cast("string"))).when(k % 12 == 0, "")
    return books(spark, d).where("id % 3 = 0").select("id", "slug", F.col("language_code").alias("language"), of.alias("translation_of_slug"))


@query(
    "batch_parents",
    f"""WITH {BOOKS}, {BATCH}, m AS (SELECT b.slug, b.language, nullif(b.translation_of_slug, '') AS wanted, o.slug IS NOT NULL AS parent_in_batch, o.language AS here, nullif(o.translation_of_slug, '') AS of, k.id AS kid, k.language_code AS there
      FROM batch b LEFT JOIN batch o ON o.slug = nullif(b.translation_of_slug, '') LEFT JOIN known k ON k.slug = nullif(b.translation_of_slug, ''))
    SELECT slug, kid AS parent_id, parent_in_batch, CASE WHEN wanted IS NULL THEN NULL WHEN NOT parent_in_batch AND kid IS NULL THEN 'no such original' WHEN parent_in_batch AND of IS NOT NULL THEN 'original is a translation' WHEN coalesce(here, there) = language THEN 'same language as its original' END AS error FROM m""",
)
def batch_parents(spark, d):
    known = books(spark, d).where("id % 3 <> 0 and id % 9 <> 2").select("id", "slug", "language_code")
    return ingest.batch_parents(batch_rows(spark, d), known).select("slug", "parent_id", "parent_in_batch", "error")


@query(
    "import_all_or_nothing",
    f"WITH {BOOKS} SELECT count(*) AS good, 0 AS bad FROM books",
)
def import_all_or_nothing(spark, d):
    rows = books(spark, d)
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    good = count(ingest.all_or_nothing(rows.withColumn("error", F.lit(None).cast("string"))), "good")
    bad = ingest.all_or_nothing(rows.withColumn("error", F.when(F.col("id") % 50 == 7, "bad")))
    return good.join(count(bad, "bad").select(F.col("bad").cast("int").alias("bad")))


GROUPS = "files AS (SELECT o_orderkey // 4 AS folder, 's' || o_orderkey AS slug, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 5 <> 0 THEN 'fr' WHEN o_orderkey % 2 = 1 THEN 'sw' WHEN o_orderkey % 4 = 0 THEN 'de' ELSE 'en' END AS language, CASE WHEN o_orderkey % 22 = 1 THEN 'given' END AS translation_of_slug FROM orders WHERE o_orderkey % 7 <> 2)"


@query(
    "paired_groups",
    f"""WITH {GROUPS}, g AS (SELECT folder, coalesce(min(slug) FILTER (language = 'en'), min(slug)) AS root_slug, count(*) <> count(DISTINCT language) AS twice FROM files GROUP BY 1)
    SELECT folder, slug, language, root_slug, CASE WHEN slug = root_slug THEN translation_of_slug ELSE coalesce(translation_of_slug, root_slug) END AS translation_of_slug, CASE WHEN twice THEN 'two editions of one language' END AS error FROM files JOIN g USING (folder)""",
)
def paired_groups(spark, d):
    k = F.col("o_orderkey")
    language = F.when((k % 4 == 3) & (k % 5 != 0), "fr").when(k % 2 == 1, "sw").when(k % 4 == 0, "de").otherwise("en")
    files = table(spark, d, "orders").where("o_orderkey % 7 <> 2").select(F.floor(k / 4).alias("folder"), F.concat(F.lit("s"), k.cast("string")).alias("slug"), language.alias("language"), F.when(k % 22 == 1, "given").alias("translation_of_slug"))
    return ingest.paired_groups(files)


@query(
    "chapters_only_gate",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no such book' WHEN doc_id % 4 = 1 THEN 'must include integrity metadata' END AS error, CASE WHEN doc_id % 4 = 2 THEN 'stored' ELSE 'sent' END AS title FROM documents""",
)
def chapters_only_gate(spark, d):
    k = F.col("doc_id")
    integrity = F.lit(None).cast("struct<verified:boolean,source_sha:string,rebuilt_sha:string,source_words:bigint,rebuilt_words:bigint,coverage:double,min_words:bigint,max_words:bigint,suspicious:bigint,source_start:string,source_end:string,rebuilt_start:string,rebuilt_end:string>")
    docs = table(spark, d, "documents")
    # the sent tags say the opposite of the stored ones
    sent = docs.select("doc_id", k.cast("string").alias("slug"), F.lit("sent").alias("title"), F.array(F.when(k % 4 == 1, "Modern").otherwise("English Classics")).alias("tags"), integrity.alias("integrity"), F.array(F.struct(F.lit("t").alias("title"), F.col("text").alias("content"))).alias("chapters"))
    stored = docs.where("doc_id % 4 <> 0").select(k.cast("string").alias("slug"), F.when(k % 4 == 2, "stored").otherwise("").alias("title"), F.array(F.when(k % 4 == 1, "English Classics").otherwise("Modern")).alias("tags"))
    return ingest.chapters_only_errors(sent, stored).select("doc_id", "error", "title")


@query(
    "precomputed_gate",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'has invalid least words' WHEN doc_id % 7 = 0 THEN 'contains a too long chapter' WHEN doc_id % 11 = 0 THEN 'contains a suspicious chapter' WHEN doc_id % 13 = 0 THEN 'must preserve all source words' END AS error FROM documents WHERE doc_id % 5 = 0 OR doc_id % 13 <> 0 OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0)""",
)
def precomputed_gate(spark, d):
    k, sha = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, d, "documents").where("doc_id % 5 = 0 or doc_id % 13 <> 0 or (doc_id % 7 <> 0 and doc_id % 11 <> 0)")
    whole = (k % 13 != 0) | (k % 5 == 0)
    record = F.struct(
        F.lit(True).alias("verified"), sha.alias("source_sha"), F.upper(sha).alias("rebuilt_sha"), F.lit(9).cast("long").alias("source_words"), F.lit(9).cast("long").alias("rebuilt_words"), F.when(whole, 1.0).otherwise(0.99).alias("coverage"),
        F.when(k % 5 == 0, -1).otherwise(1).cast("long").alias("min_words"), F.when(k % 7 == 0, 50_001).otherwise(50_000).cast("long").alias("max_words"), F.when(k % 11 == 0, 1).otherwise(0).cast("long").alias("suspicious"),
    )
    return ingest.integrity_errors(docs.select("doc_id", F.array(F.lit("english classics ")).alias("tags"), record.alias("integrity"), F.array().cast("array<struct<title:string,content:string>>").alias("chapters")), precomputed=True).select("doc_id", "error")


SINGLE = "SELECT o_orderkey, CASE WHEN n = 0 OR n > 100 THEN 'provide between 1 and 100 chapters' WHEN n > 1 AND (o_orderkey % 5 = 0 OR o_orderkey % 11 = 0) THEN 'every chapter needs its own positive number, a title and content' WHEN n = 1 AND o_orderkey % 11 = 0 THEN 'every chapter needs its own positive number, a title and content' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'title, author and language are required' END AS error FROM (SELECT o_orderkey, o_custkey % 103 AS n FROM orders)"


@query("single_imports", SINGLE)
def single_imports(spark, d):
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 103).cast("int")
    number = lambda i: F.when((k % 5 == 0) & (i == n), 1).otherwise(i).cast("long")
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(number(i).alias("number"), F.lit("t").alias("title"), F.when((k % 11 == 0) & (i == n), " ").otherwise("c").alias("content")))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, k).alias("book_id"), F.when(k % 3 == 0, "").otherwise("T").alias("title"), F.lit("A").alias("author"), F.lit("en").alias("language"), F.when(n > 0, made).alias("chapters"))
    return ingest.single_import_errors(rows).select("o_orderkey", "error")


@query(
    "publication_steps",
    f"""WITH {BOOKS}, {CHAPTERS}, b AS (SELECT id, CASE WHEN id % 20 = 0 THEN 'published' ELSE 'draft' END AS status FROM books WHERE id % 10 = 0), s AS (SELECT book_id, chapter_number, 'published' AS status FROM chapters WHERE book_id % 10 = 0 AND chapter_number % 2 = 1),
    n AS (SELECT b.id, b.status, count(s.book_id) AS total FROM b LEFT JOIN s ON s.book_id = b.id GROUP BY ALL)
    SELECT 'staged' AS step, id, 0 AS number, coalesce(CASE WHEN n.id IS NULL THEN books.status END, 'draft') AS status, CASE WHEN n.id IS NULL THEN published_at END AS published_at, coalesce(total, total_chapters) AS total FROM books LEFT JOIN n USING (id)
    UNION ALL SELECT 'final', id, 0, coalesce(n.status, books.status), CASE WHEN n.id IS NULL THEN published_at WHEN n.status = 'published' THEN TIMESTAMP '{NOW}' END, coalesce(total, total_chapters) FROM books LEFT JOIN n USING (id)
    UNION ALL SELECT 'chapters', book_id, chapter_number, CASE WHEN book_id % 10 = 0 THEN 'published' ELSE status END, CASE WHEN book_id % 10 = 0 THEN TIMESTAMP '{NOW}' ELSE published_at END, 0 FROM chapters WHERE book_id % 10 <> 0 OR chapter_number % 2 = 1""",
)
def publication_steps(spark, d):
    all_books, all_chapters = books(spark, d), chapters(spark, d)
    batch = all_books.where("id % 10 = 0").withColumn("status", F.when(F.col("id") % 20 == 0, "published").otherwise("draft"))
    sent = all_chapters.where("book_id % 10 = 0 and chapter_number % 2 = 1").withColumn("status", F.lit("published"))
    staged, kept, final = ingest.publication(all_books, all_chapters, batch, sent, NOW)
    of_books = lambda rows, step: rows.select(F.lit(step).alias("step"), "id", F.lit(0).alias("number"), "status", "published_at", F.col("total_chapters").alias("total"))
    of_chapters = kept.select(F.lit("chapters").alias("step"), F.col("book_id").alias("id"), F.col("chapter_number").alias("number"), "status", "published_at", F.lit(0).cast("long").alias("total"))
    return of_books(staged, "staged").unionByName(of_books(final, "final")).unionByName(of_chapters)


@query("guarded_deletes", f"WITH {BOOKS} SELECT 'slugs' AS run, (SELECT count(*) FROM books) - count(*) AS stay, count(*) AS gone, 1 AS missing FROM books WHERE slug IN ('book-2', 'book-4', 'book-6-sw') UNION ALL SELECT 'all', 0, count(*), 0 FROM books")
def guarded_deletes(spark, d):
    rows = books(spark, d)
    runs = {"slugs": ingest.guarded_delete(rows, ["book-2", " book-4 ", "book-6-sw", "no-book", "book-2", "Not A Slug"]), "all": ingest.guarded_delete(rows, [], ingest.DELETE_ALL)}
    parts = [part.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(name).alias("name"), "n") for run, found in runs.items() for name, part in zip(("stay", "gone", "missing"), found, strict=True)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy("run").pivot("name", ["stay", "gone", "missing"]).agg(F.first("n")).select("run", "stay", "gone", F.col("missing").cast("int").alias("missing"))


@query("linked_translations", f"WITH {BOOKS}, o AS (SELECT id AS oid, slug || '-sw' AS twin FROM books WHERE language_code = 'en' AND parent_book_id IS NULL) SELECT id, coalesce(parent_book_id, CASE WHEN language_code = 'sw' THEN oid END) AS parent_book_id FROM books LEFT JOIN o ON slug = twin")
def linked_translations(spark, d):
    return ingest.linked_translations(books(spark, d)).select("id", "parent_book_id")


@query(
    "removed_parents",
    f"WITH {BOOKS}, {CHAPTERS} SELECT 'cascade' AS rule, CAST(NULL AS BIGINT) AS id, book_id AS reference, chapter_number AS number FROM chapters WHERE book_id % 8 <> 0 UNION ALL SELECT 'set null', id, CASE WHEN parent_book_id % 8 <> 0 THEN parent_book_id END, 0 FROM books",
)
def removed_parents(spark, d):
    gone = books(spark, d).where("id % 8 = 0").select("id")
    kept = ingest.without_parents(chapters(spark, d), gone, "book_id", "cascade").select(F.lit("cascade").alias("rule"), F.lit(None).cast("long").alias("id"), F.col("book_id").alias("reference"), F.col("chapter_number").alias("number"))
    freed = ingest.without_parents(books(spark, d), gone, "parent_book_id", "set null").select(F.lit("set null").alias("rule"), "id", F.col("parent_book_id").alias("reference"), F.lit(0).alias("number"))
    return kept.unionByName(freed)


@query("touched_rows", f"WITH {BOOKS} SELECT id, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM books WHERE id % 3 = 0")
def touched_rows(spark, d):
    rows = books(spark, d).select("id", "updated_at")
    return ingest.touched(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), "id", NOW)


@query("batch_totals", f"WITH {BOOKS} SELECT count(*) AS books, CAST(sum(1 + id % 4) AS BIGINT) AS chapters, count(*) FILTER (id % 5 <> 0) AS creates, count(*) FILTER (id % 5 = 0) AS updates FROM books WHERE id % 3 = 0")
def batch_totals(spark, d):
    rows = books(spark, d)
    batch = rows.where("id % 3 = 0").select("slug", F.sequence(F.lit(0).cast("long"), F.col("id") % 4).alias("chapters"))
    return ingest.batch_totals(batch, rows.where("id % 5 = 0"))


@query(
    "patched_books",
    f"""WITH {BOOKS}, p AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'add a cover before publishing' WHEN id % 5 = 0 THEN 'add a description before publishing' END AS error FROM books)
    SELECT id, CASE WHEN id % 2 = 0 OR error IS NOT NULL THEN title ELSE 'New' END AS title, CASE WHEN id % 2 = 0 OR error IS NOT NULL THEN status ELSE 'published' END AS status, CASE WHEN id % 2 = 0 OR error IS NOT NULL THEN published_at ELSE TIMESTAMP '{NOW}' END AS published_at, CASE WHEN id % 2 = 1 THEN error END AS error FROM p""",
)
def patched_books(spark, d):
    k = F.col("id")
    rows = books(spark, d).withColumns({"cover_url": F.when(k % 3 != 0, "c"), "description": F.when(k % 5 == 0, "").otherwise("d")})
    patches = rows.where("id % 2 = 1").select("id", F.create_map(F.lit("title"), F.lit("New"), F.lit("status"), F.lit("published"), F.lit("slug"), F.lit("not permitted")).alias("changes"))
    return ingest.patch(rows, patches, NOW).select("id", "title", "status", "published_at", "error")


@query("withdrawn_rows", f"WITH {CHAPTERS} SELECT book_id, chapter_number FROM chapters WHERE book_id % 6 <> 1")
def withdrawn_rows(spark, d):
    return stream.withdraw(chapters(spark, d), books(spark, d).where("id % 6 = 1").select(F.col("id").alias("book_id")), "book_id").select("book_id", "chapter_number")


# --- publishing


@query("page_versions", f"WITH {BOOKS}, w AS (SELECT *, coalesce(parent_book_id, id) AS root FROM books) SELECT a.id, b.slug AS version_slug, b.language_code AS version_language FROM w a JOIN w b ON a.root = b.root AND a.slug <> b.slug")
def page_versions(spark, d):
    return publish.page_versions(books(spark, d))


PAGES = f"pages_ AS (SELECT '{SITE}/books/' || slug || '/' AS url, language_code AS language, CASE WHEN id % 2 = 0 THEN strftime(updated_at, '%Y-%m-%d') END AS lastmod FROM books UNION ALL SELECT '{SITE}/read/' || slug || '/1', language_code, NULL FROM books UNION ALL VALUES ('{SITE}/', 'en', NULL), ('{SITE}/books/', 'en', NULL))"


def pages(spark, d):
    rows = books(spark, d)
    page = rows.select(F.concat(F.lit(f"{SITE}/books/"), "slug", F.lit("/")).alias("url"), F.col("language_code").alias("language"), F.when(F.col("id") % 2 == 0, F.date_format("updated_at", "yyyy-MM-dd")).alias("lastmod"))
    reading = rows.select(publish.chapter_url(F.col("slug"), F.lit(1)).alias("url"), F.col("language_code").alias("language"), F.lit(None).cast("string").alias("lastmod"))
    fixed = spark.createDataFrame([(f"{SITE}/", "en", None), (f"{SITE}/books/", "en", None)], "url string, language string, lastmod string")
    return page.unionByName(reading).unionByName(fixed)


@query(
    "sitemap_pages",
    f"""WITH {BOOKS}, {PAGES} SELECT CASE WHEN url LIKE '{SITE}/read/%' THEN 'chapters' WHEN url IN ('{SITE}/', '{SITE}/books/') THEN 'home' WHEN language = 'sw' THEN 'books-sw' ELSE 'books-en' END AS sitemap, url,
    '<url><loc>' || url || '</loc><lastmod>' || coalesce(lastmod, '2000-01-01') || '</lastmod><changefreq>' || CASE WHEN url LIKE '{SITE}/read/%' THEN 'monthly' ELSE 'weekly' END || '</changefreq><priority>' || CASE WHEN url = '{SITE}/' THEN '1.0' WHEN url LIKE '{SITE}/read/%' THEN '0.6' ELSE '0.8' END || '</priority></url>' AS element FROM pages_""",
)
def sitemap_pages(spark, d):
    return publish.sitemap_pages(pages(spark, d), "2000-01-01")


@query(
    "annotated_pages",
    f"""WITH {BOOKS}, {PAGES}, links AS (SELECT '{SITE}/books/' || slug || '/' AS canonical, list_sort(list(DISTINCT code || ' ' || target)) AS links FROM (SELECT slug, language_code AS code, '{SITE}/books/' || slug || '/' AS target FROM books WHERE id % 3 <> 0 UNION ALL SELECT slug, 'x-default', '{SITE}/books/' || regexp_replace(slug, '-sw$', '') || '/' FROM books WHERE id % 3 <> 0) GROUP BY slug)
    SELECT url, array_to_string(links, ',') AS links FROM pages_ LEFT JOIN links ON url = canonical""",
)
def annotated_pages(spark, d):
    rows = books(spark, d).where("id % 3 <> 0")
    address = lambda slug: F.concat(F.lit(f"{SITE}/books/"), slug, F.lit("/"))
    own = rows.select(address(F.col("slug")).alias("canonical"), F.col("language_code").alias("code"), address(F.col("slug")).alias("url"))
    default = rows.select(address(F.col("slug")).alias("canonical"), F.lit("x-default").alias("code"), address(F.regexp_replace("slug", "-sw$", "")).alias("url"))
    found = publish.annotated(pages(spark, d), own.unionByName(default))
    return found.select("url", F.array_join(F.transform("links", lambda x: F.concat(x["code"], F.lit(" "), x["url"])), ",").alias("links"))


@query(
    "book_pages",
    f"""WITH {BOOKS}, {CHAPTERS}, l AS (SELECT id, string_agg('<li><a href="{SITE}/read/' || slug || '/' || chapter_number || '">' || c.title || '</a></li>', '' ORDER BY chapter_number) AS items FROM chapters c JOIN books ON id = book_id GROUP BY 1),
    w AS (SELECT *, coalesce(parent_book_id, id) AS root FROM books), v AS (SELECT a.id, string_agg(DISTINCT '<a href="{SITE}/books/' || b.slug || '/" hreflang="' || b.language_code || '"></a>', '') AS others FROM w a JOIN w b ON a.root = b.root AND a.slug <> b.slug GROUP BY 1)
    SELECT books.id, '<!doctype html><title>' || title || '</title><link rel="canonical" href="{SITE}/books/' || slug || '/"><h1>' || title || '</h1><p>' || CASE WHEN books.id % 2 = 0 THEN 'Tom &amp; &lt;Asha&gt;' ELSE '' END || '</p><ol>' || coalesce(items, '') || '</ol>' || coalesce(others, '') AS page FROM books LEFT JOIN l USING (id) LEFT JOIN v USING (id)""",
)
def book_pages(spark, d):
    rows = books(spark, d).withColumn("description", F.when(F.col("id") % 2 == 0, "Tom & <Asha>"))
    return publish.book_page(rows, chapters(spark, d))


@query(
    "feed_document",
    f"""WITH {BOOKS}, i AS (SELECT id, '<item><title>' || title || '</title><link>{SITE}/books/' || slug || '</link><pubDate>' || strftime(updated_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>' AS item FROM books ORDER BY updated_at DESC, id LIMIT 5)
    SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>News &amp; more</title><link>{SITE}/books/</link><language>en</language><lastBuildDate>now</lastBuildDate>' || string_agg(item, '' ORDER BY id) || '</channel></rss>' || chr(10) AS document FROM i""",
)
def feed_document(spark, d):
    return publish.feed(publish.feed_items(books(spark, d), 5), "News & more", "now")


@query("catalogue_counts", f"WITH {BOOKS} SELECT count(*) FILTER (language_code <> 'sw') AS english, count(*) FILTER (language_code = 'sw') AS kiswahili, count(*) FILTER (id % 13 = 0) AS classics, count(*) AS editions FROM books")
def catalogue_counts(spark, d):
    return publish.catalogue_counts(tagged(spark, d))


@query("listing_lines", f"WITH {BOOKS} SELECT slug, '- [' || title || ']({SITE}/books/' || slug || '/) by ' || author_name || ': ' || CASE WHEN id % 2 = 0 THEN repeat('ab ', 53) || 'a' ELSE '' END AS line FROM books")
def listing_lines(spark, d):
    return publish.llms_listing(books(spark, d).withColumn("description", F.when(F.col("id") % 2 == 0, F.concat(F.repeat(F.lit("ab  "), 80), F.lit("\n\nnext")))))


@query("rebuilt_books", f"WITH {BOOKS} SELECT slug, CASE WHEN id % 2 <> 0 THEN 'added' WHEN id % 3 <> 0 THEN 'removed' ELSE 'changed' END AS state FROM books WHERE id % 2 = 0 OR id % 3 = 0")
def rebuilt_books(spark, d):
    hashes = publish.content_hash(books(spark, d).select("id", "slug", "title"), "slug").join(books(spark, d).select("slug", "id"), "slug")
    before = hashes.where("id % 2 = 0").withColumn("code_hash", F.lit("old"))
    return publish.rebuild(hashes.where("id % 3 = 0"), before, "new")


@query(
    "record_problems",
    f"""WITH {CHAPTERS}, c AS (SELECT *, CASE WHEN chapter_number = 3 AND book_id % 4 = 0 THEN 0 WHEN chapter_number = 2 AND book_id % 7 = 0 THEN 1 ELSE chapter_number END AS n, CASE WHEN book_id % 9 = 0 AND chapter_number = 1 THEN ' ' ELSE 'x' END AS body FROM chapters)
    SELECT DISTINCT book_id, problem FROM (SELECT book_id, 'number below 1' AS problem FROM c WHERE n < 1 UNION ALL SELECT book_id, 'empty body' FROM c WHERE trim(body) = '' UNION ALL SELECT book_id, 'repeated number' FROM c GROUP BY book_id, n HAVING count(*) > 1)""",
)
def record_problems(spark, d):
    b, n = F.col("book_id"), F.col("chapter_number")
    rows = chapters(spark, d).select("book_id", F.when((n == 3) & (b % 4 == 0), 0).when((n == 2) & (b % 7 == 0), 1).otherwise(n).alias("chapter_number"), F.when((b % 9 == 0) & (n == 1), " ").otherwise("x").alias("content"))
    return publish.record_problems(rows)


@query("total_mismatches", f"WITH {BOOKS}, {CHAPTERS}, n AS (SELECT book_id, count(*) AS n FROM chapters WHERE status = 'published' GROUP BY 1) SELECT id, total_chapters, coalesce(n, 0) AS published FROM books LEFT JOIN n ON book_id = id WHERE total_chapters > 0 AND total_chapters <> coalesce(n, 0)")
def total_mismatches(spark, d):
    return publish.total_mismatches(books(spark, d), chapters(spark, d))


@query("reconciled_chapters", f"WITH {CHAPTERS} SELECT book_id, chapter_number FROM chapters WHERE book_id % 3 <> 0 AND chapter_number % 2 = 0 AND book_id IN (SELECT book_id FROM chapters WHERE chapter_number % 2 = 1)")
def reconciled_chapters(spark, d):
    saved = chapters(spark, d)
    manifests = publish.read_manifest(publish.manifest(books(spark, d), saved.where("chapter_number % 2 = 1"))).withColumn("complete", F.col("complete") & (F.col("book_id") % 3 != 0))
    return publish.reconcile(saved, manifests).select("book_id", "chapter_number")


@query(
    "middle_inserts",
    "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, CAST(len(p) + CASE WHEN len(p) >= 20 THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN len(p) >= 20 THEN CAST(len(p) // 2 + 1 AS BIGINT) ELSE 0 END AS place FROM p",
)
def middle_inserts(spark, d):
    paragraphs = F.filter(F.transform(F.split("text", "\\n"), F.trim), lambda p: p != "")
    rows = table(spark, d, "documents").select("doc_id", publish.middle_insert(paragraphs, F.lit("\0inserted")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.array_position("p", "\0inserted").alias("place"))


@query(
    "chapter_pages",
    f"""SELECT conv_id, turn, sha256('<!doctype html><title>T &lt;' || turn || '&gt;</title><link rel="canonical" href="{SITE}/read/a%20b/' || turn || '"><h1>T &lt;' || turn || '&gt;</h1>' || chr(10) || CASE WHEN trim(text) = '' THEN '' ELSE '<p>' || replace(replace(replace(replace(replace(trim(text, ' ' || chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>' END) AS digest
    FROM conversations WHERE NOT regexp_matches(text, '\\n\\s*\\n')""",
)
def chapter_pages(spark, d):
    rows = table(spark, d, "conversations").where(~F.col("text").rlike("\\n\\s*\\n"))
    title = F.concat(F.lit("T <"), F.col("turn").cast("string"), F.lit(">"))
    return rows.select("conv_id", "turn", F.sha2(publish.chapter_page(F.lit("a b"), title, F.col("turn"), F.col("text")), 256).alias("digest"))


# --- audits


@query("offline_books", "SELECT c_custkey AS book_id, count(o_orderkey) AS downloaded_count, count(o_orderkey) > 0 AS is_available FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 5 = 0 GROUP BY 1")
def offline_books(spark, d):
    saved = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("book_id"))
    return audit.offline_status(saved, table(spark, d, "customer").select(F.col("c_custkey").alias("book_id")))


@query("stored_sizes", "SELECT o_custkey AS book_id, count(*) AS chapters, CAST(sum(length(o_orderpriority) + length(o_orderstatus)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def stored_sizes(spark, d):
    return audit.stored_sizes(table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("ciphertext"), F.col("o_orderstatus").alias("iv")))


@query("files_to_transfer", "SELECT page_id AS path, length(html) AS bytes FROM pages WHERE page_id % 4 = 0 OR page_id % 3 = 0")
def files_to_transfer(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.length("html").cast("long").alias("bytes"))
    return audit.to_transfer(rows, rows.where("path % 4 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("path") % 3 == 0, 10).otherwise(9)))


@query("same_characters", "SELECT doc_id, doc_id % 3 <> 0 OR regexp_replace(text, '\\s', '', 'g') = '' AS same FROM documents")
def same_characters(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    other = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "^\\s*\\S", "")).otherwise(F.reverse("text")).alias("text"))
    return audit.same_characters(rows, other, "doc_id", "text")
