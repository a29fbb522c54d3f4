"""Queries on what is kept and published: paged scans, versions, ledgers, keyed files, site maps, reports, sealed texts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from folioloom.functions import codes, text
from folioloom.operators import audit, events, formatting, publish
from folioloom.sources import epub, keyed, paged, shared, versions
from folioloom.streaming import events as stream
from folioloom.streaming import ledger, readers, reports

from .book_queries import chapters
from .stand_ins import BOOKS, CHAPTERS, EVENT_NOW, READINGS, books, dealt, reading_events, table

QUERIES, ORACLE_SQL = {}, {}
SITE = publish.SITE
#: ECMAScript white space in DuckDB's regular expressions.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return keep


def fresh(spark, label: str) -> str:
    """A new folder in the shared one."""
    return f"{shared.root(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources


@query("paged_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey // 1000 AS page FROM orders")
def paged_orders(spark, d):
    return paged.scan(spark, "o_orderkey", path=f"{d}/orders.parquet", pageColumn="page")


PATHS = "paths AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)"


@query(
    "folder_pages",
    f"""WITH {PATHS}, e AS (SELECT DISTINCT array_to_string(p[:k - 1], '/') AS folder, p[k] AS name, k < len(p) AS is_folder FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM paths)),
    n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY is_folder DESC, name) AS position FROM e) SELECT folder, name, is_folder, position, (position - 1) // 20 + 1 AS page FROM n""",
)
def folder_pages(spark, d):
    return audit.folder_pages(table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")), 20)


def html_text_sql(c: str) -> str:
    """As ``text.html_text``, of what has no script, style or comment."""
    signs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]
    out = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in signs:
        out = f"replace({out}, '{name}', '{sign}')"
    return f"regexp_replace(regexp_replace({out}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


@query(
    "epub_chapters",
    rf"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS body FROM pages),
    t AS (SELECT page_id, html, array_to_string(list_filter(list_transform(string_split(regexp_replace(body, '(?i)</?(?:p|div|section|h[1-6]|li|blockquote)\b[^>]*>', chr(1), 'g'), chr(1)), lambda x: {html_text_sql('x')}), lambda x: length(x) >= 6), chr(10) || chr(10)) AS body FROM b)
    SELECT 'Pages ' || page_id // 5 AS title, CAST(row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id DESC) AS INTEGER) AS number, {html_text_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS chapter_title, sha256(body) AS digest FROM t WHERE length(body) >= 50""",
)
def epub_chapters(spark, d):
    """The pages as EPUB files of five, the last page first, read again as chapters."""
    folder = fresh(spark, "epub")
    books = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 5).alias("book")).agg(F.sort_array(F.collect_list(F.struct("page_id", "html")), asc=False).alias("pages"))
    keyed.publish(books.mapInPandas(_bound, "path string, content binary"), folder)
    return epub.chapters(spark, folder).select("title", "number", "chapter_title", F.sha2("text", 256).alias("digest"))


def _bound(frames):
    """Archives of some pages each, a row a book."""
    import io
    import zipfile

    for frame in frames:
        made = []
        for book, pages in zip(frame["book"], frame["pages"], strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as archive:
                archive.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="text/book.opf"/></rootfiles></container>')
                items = "".join(f'<item id="p{p["page_id"]}" href="{p["page_id"]}.xhtml"/>' for p in pages)
                order = "".join(f'<itemref idref="p{p["page_id"]}"/>' for p in pages)
                archive.writestr("text/book.opf", f"<package><metadata><dc:title>Pages {book}</dc:title></metadata><manifest>{items}</manifest><spine>{order}</spine></package>")
                for p in pages:
                    archive.writestr(f"text/{p['page_id']}.xhtml", p["html"])
            made.append((f"b-{book}.epub", held.getvalue()))
        yield pd.DataFrame(made, columns=["path", "content"])


# --- versions of several tables


@query(
    "catalogue_builds",
    f"""WITH {BOOKS} SELECT * FROM (SELECT 1 AS build, 1 AS version, 'created' AS state, count(*) AS books, count(DISTINCT category) AS categories FROM books
    UNION ALL SELECT 2, 1, 'unchanged', count(*), count(DISTINCT category) FROM books UNION ALL SELECT 3, 2, 'changed', count(*), count(DISTINCT category) FROM books WHERE id % 10 <> 3)""",
)
def catalogue_builds(spark, d):
    """Two tables built three times: at first, again from rows in another order, and after some books were withdrawn."""
    store = versions.Versions(spark, fresh(spark, "catalogue"))
    rows = books(spark, d).select("id", "slug", "title", "category", "updated_at")
    out = None
    for number, source in enumerate((rows, rows.repartition(3), rows.where("id % 10 <> 3")), 1):
        version, state = store.publish({"books": source, "categories": source.groupBy("category").agg(F.count("*").alias("books"))})
        found = store.state()["tables"]
        row = spark.range(1).select(F.lit(number).alias("build"), F.lit(version).alias("version"), F.lit(state).alias("state"))
        counted = row.join(store.read("books").agg(F.count("*").alias("books"))).join(store.read("categories").agg(F.count("*").alias("categories")))  # single rows
        assert found["books"]["rows"] >= 0
        out = shared.written(counted, "build") if out is None else out.unionByName(shared.written(counted, "build"))
    return out


RELEASES = """releases AS (
  SELECT book_id, CASE WHEN l_partkey % 5 = 0 THEN 'failed' ELSE 'success' END AS result, status AS remote_status, 'slug-' || book_id AS slug,
         CASE WHEN l_partkey % 5 = 0 THEN 'HTTP ' || (500 + l_suppkey % 4) END AS error, sent_at AS finished_at
  FROM (SELECT l_orderkey AS book_id, CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'draft' END AS status, l_shipdate AS sent_at, l_partkey, l_suppkey FROM lineitem)
)"""


@query(
    "recorded_releases",
    f"""WITH {RELEASES}, known AS (SELECT DISTINCT * FROM releases WHERE book_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1)),
    last AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY finished_at DESC, result DESC, slug DESC, error DESC NULLS LAST) = 1)
    SELECT o_orderkey AS book_id, coalesce(result, 'draft') AS publish_state, finished_at AS published_at_remote, CASE WHEN result IS NULL THEN 'none yet' ELSE error END AS last_error,
           (SELECT count(*) FROM known k WHERE k.book_id = o_orderkey) AS logged
    FROM orders LEFT JOIN last ON last.book_id = o_orderkey WHERE o_orderkey % 4 <> 1""",
)
def recorded_releases(spark, d):
    """The log and the books of the version that holds both, after the same releases were recorded twice."""
    rows = table(spark, d, "lineitem")
    failed = F.col("l_partkey") % 5 == 0
    releases = rows.select(
        F.col("l_orderkey").alias("book_id"), F.when(failed, "failed").otherwise("success").alias("result"), F.when(F.col("l_linestatus") == "F", "published").otherwise("draft").alias("remote_status"),
        F.concat(F.lit("slug-"), F.col("l_orderkey").cast("string")).alias("slug"), F.when(failed, F.concat(F.lit("HTTP "), (F.col("l_suppkey") % 4 + 500).cast("string"))).alias("error"), F.col("l_shipdate").cast("timestamp").alias("finished_at"),
    )
    none = F.lit(None)
    start = table(spark, d, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("book_id"), F.lit("draft").alias("publish_state"), none.cast("string").alias("published_slug"), none.cast("timestamp").alias("published_at_remote"), F.lit("none yet").alias("last_error"))
    store = versions.Versions(spark, fresh(spark, "releases"))
    store.publish({"publishes": releases.limit(0), "books": start})
    for _ in range(2):
        log, now = audit.recorded(store.read("publishes"), store.read("books"), releases)
        store.publish({"publishes": log, "books": now})
    logged = store.read("publishes").groupBy("book_id").agg(F.count("*").alias("_n"))
    return store.read("books").join(logged, "book_id", "left").select("book_id", "publish_state", "published_at_remote", "last_error", F.coalesce("_n", F.lit(0).cast("long")).alias("logged"))


# --- files by key


PAGE = f"""'<!doctype html><title>Turn ' || turn || '</title><link rel="canonical" href="{SITE}/read/conv-' || conv_id || '/' || turn || '"><h1>Turn ' || turn || '</h1>' || chr(10) || array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''),
  lambda p: '<p>' || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>'), chr(10))"""


def conversation_pages(spark, d):
    slug, number = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.col("turn")
    page = publish.chapter_page(slug, F.concat(F.lit("Turn "), number.cast("string")), number, F.col("text"))
    return table(spark, d, "conversations").select(F.concat(slug, F.lit("/"), number.cast("string"), F.lit(".html")).alias("path"), page.alias("content"))


@query("published_files", f"SELECT 'conv-' || conv_id || '/' || turn || '.html' AS path, octet_length(encode({PAGE})) AS bytes FROM conversations")
def published_files(spark, d):
    """Pages written as files by key, and read back from what was published."""
    folder = fresh(spark, "pages")
    keyed.publish(conversation_pages(spark, d), folder)
    return keyed.published(spark, folder)


@query("generated_pages", f"SELECT count(*) AS pages, CAST(sum(octet_length(encode({PAGE}))) AS BIGINT) AS bytes FROM conversations")
def generated_pages(spark, d):
    return publish.generated(conversation_pages(spark, d))


# --- site maps and feeds


ELEMENTS = f"""elements AS (
  SELECT 'chapters' AS sitemap, '{SITE}/read/' || slug || '/' || chapter_number AS url, strftime(coalesce(c.published_at, TIMESTAMP '2000-01-01'), '%Y-%m-%d') AS lastmod
  FROM chapters c JOIN books ON id = book_id
  UNION ALL SELECT 'books', '{SITE}/books/' || slug || '/', strftime(updated_at, '%Y-%m-%d') FROM books
), sized AS (
  SELECT *, octet_length(encode('<url><loc>' || url || '</loc><lastmod>' || lastmod || '</lastmod></url>')) + 1 AS size FROM elements
), placed AS (
  SELECT *, row_number() OVER w - 1 AS r, sum(size) OVER (PARTITION BY sitemap ORDER BY url ROWS UNBOUNDED PRECEDING) - size AS b, max(size) OVER () AS longest FROM sized WINDOW w AS (PARTITION BY sitemap ORDER BY url)
), split AS (
  SELECT *, dense_rank() OVER (PARTITION BY sitemap ORDER BY r // 700, b // (50000 - longest + 1)) AS child FROM placed
), children AS (
  SELECT sitemap || '-' || child AS name, count(*) AS urls, CAST(sum(size) AS BIGINT) AS bytes, min(url) AS first_url, max(url) AS last_url, max(lastmod) AS lastmod FROM split GROUP BY sitemap, child
)"""


def split_pages(spark, d):
    rows = books(spark, d)
    own = rows.select(F.lit("books").alias("sitemap"), F.concat(F.lit(f"{SITE}/books/"), "slug", F.lit("/")).alias("url"), F.date_format("updated_at", "yyyy-MM-dd").alias("lastmod"))
    both = chapters(spark, d).select(F.col("book_id").alias("id"), "chapter_number", F.col("published_at").alias("_at")).join(rows.select("id", "slug"), "id")
    reading = both.select(F.lit("chapters").alias("sitemap"), publish.chapter_url(F.col("slug"), F.col("chapter_number")).alias("url"), F.date_format(F.coalesce("_at", F.lit("2000-01-01").cast("timestamp")), "yyyy-MM-dd").alias("lastmod"))
    element = F.concat(F.lit("<url><loc>"), text.html_escape(F.col("url")), F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></url>"))
    return publish.split_sitemap(own.unionByName(reading).withColumn("element", element), 700, 50_000)


@query("sitemap_children", f"WITH {BOOKS}, {CHAPTERS}, {ELEMENTS} SELECT * FROM children")
def sitemap_children(spark, d):
    return publish.sitemap_children(split_pages(spark, d))


@query(
    "sitemap_indexes",
    f"""WITH {BOOKS}, {CHAPTERS}, {ELEMENTS}, n AS (SELECT *, (row_number() OVER (ORDER BY name) - 1) // 10 + 1 AS number FROM children)
    SELECT number, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<sitemap><loc>{SITE}/sitemap-' || name || '.xml</loc><lastmod>' || lastmod || '</lastmod></sitemap>', '' ORDER BY name) || '</sitemapindex>' || chr(10) AS document FROM n GROUP BY number""",
)
def sitemap_indexes(spark, d):
    return publish.sitemap_indexes(publish.sitemap_children(split_pages(spark, d)), 10)


@query(
    "feed_rows",
    f"""WITH {BOOKS} SELECT row_number() OVER (ORDER BY updated_at DESC, id) AS rank,
    '<item><title>' || title || '</title><link>{SITE}/books/' || slug || '/</link><guid>{SITE}/books/' || slug || '/</guid><pubDate>' || strftime(updated_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate><description>' ||
    CASE id % 3 WHEN 0 THEN 'By ' || author_name || ' &amp; others' ELSE 'Read ' || title END || '</description><category>' || category || '</category><category>' || CASE language_code WHEN 'sw' THEN 'Kiswahili' ELSE 'English' END || '</category></item>' AS item FROM books""",
)
def feed_rows(spark, d):
    told = F.when(F.col("id") % 3 == 0, F.concat(F.lit("By "), "author_name", F.lit(" & others"))).when(F.col("id") % 3 == 1, "  ")
    return publish.feed_rows(books(spark, d).withColumn("description", told))


@query("rolled_over", "SELECT 'v' || o_orderkey % 7 AS version, count(*) AS rows, o_orderkey % 7 = 6 AS kept FROM orders GROUP BY ALL")
def rolled_over(spark, d):
    return publish.rolled_over(table(spark, d, "orders").select(F.concat(F.lit("v"), (F.col("o_orderkey") % 7).cast("string")).alias("version")), "v6")


# --- matches, sealed texts, tags, blocks


IDS = """ids AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '_' || replace(p_name, ' ', '_') || CASE WHEN o_orderkey % 3 = 0 THEN '_' || lower(p_type) ELSE '' END AS book_id FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderstatus = 'F')"""
SLUGS = """slugs AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'the-' || replace(p_name, ' ', '-') || '-' || p_size WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN lower(p_type) ELSE 'volume-' || p_partkey END AS slug FROM part)"""


@query(
    "slug_matches",
    f"""WITH {IDS}, {SLUGS}, each AS (SELECT DISTINCT slug FROM slugs), met AS (SELECT slug, min(book_id) AS book_id FROM each, ids WHERE ends_with(book_id, slug) OR contains(replace(slug, '-', '_'), regexp_extract(book_id, '^[^_]*_(.*)$', 1)) GROUP BY 1)
    SELECT p_partkey, slug, book_id FROM slugs LEFT JOIN met USING (slug)""",
)
def slug_matches(spark, d):
    part, orders = table(spark, d, "part"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    both = orders.join(part.hint("merge"), F.col("o_custkey") == F.col("p_partkey"))  # part's file is far smaller than its rows
    ids = both.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("_"), F.lower("p_type"))).otherwise("")).alias("book_id"))
    k, name = F.col("p_partkey"), F.col("p_name")
    slug = F.when(k % 4 == 0, F.concat(F.lit("the-"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"))).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 4 == 2, F.lower("p_type")).otherwise(F.concat(F.lit("volume-"), k.cast("string")))
    rows = part.select("p_partkey", slug.alias("slug"))
    return rows.join(audit.match_ids(rows.select("slug").distinct(), ids).hint("merge"), "slug")


@query("sealed_texts", "SELECT doc_id, sha256(text) AS opened, octet_length(encode(text)) + 28 AS sealed_bytes, TRUE AS changed_refused, TRUE AS other_refused FROM documents")
def sealed_texts(spark, d):
    """Each text sealed and opened; opened after one byte was changed, and for another document."""
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"))
    bound = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    rows = shared.written(table(spark, d, "documents").select("doc_id", codes.sealed(F.col("text"), key, bound).alias("body")), "sealed")  # the initial vectors are random
    digits = F.hex("body")
    changed = F.unhex(F.concat(F.substring(digits, 1, 24), F.when(F.substring(digits, 25, 1) == "0", "1").otherwise("0"), F.substring(digits, 26, 1 << 30)))
    return rows.select(
        "doc_id", F.sha2(codes.opened(F.col("body"), key, bound), 256).alias("opened"), F.octet_length("body").cast("long").alias("sealed_bytes"),
        codes.opened(changed, key, bound).isNull().alias("changed_refused"), codes.opened(F.col("body"), key, F.concat(bound, F.lit("x"))).isNull().alias("other_refused"),
    )


@query(
    "tags_of_texts",
    """WITH raw AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand, upper(p_name), p_type] WHEN 1 THEN [p_type, p_name, lower(p_brand)] ELSE [] END AS tags FROM part),
    k AS (SELECT p_partkey, list_transform(tags, lambda t: lower(t)) AS low, tags FROM raw)
    SELECT p_partkey, list_filter(tags, lambda t, i: list_position(low, lower(t)) = i) AS tags FROM k""",
)
def tags_of_texts(spark, d):
    """Tags out of values between commas, of JSON arrays with other values among them, and of no text."""
    k = F.col("p_partkey")
    commas = F.concat(F.lit(" "), "p_name", F.lit(" ,"), "p_brand", F.lit(",, "), F.upper(F.replace("p_name", F.lit(" "), F.lit("   "))), F.lit(","), "p_type", F.lit(" , "))
    listed = F.concat(F.lit('["'), "p_type", F.lit('", 7, "'), "p_name", F.lit('", null, " ", "'), F.lower("p_brand"), F.lit('"]'))
    rows = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    return rows.select("p_partkey", text.normalize_tags(text.tag_list(F.when(k % 3 == 0, commas).when(k % 3 == 1, listed))).alias("tags"))




@query(
    "block_rows",
    rf"""WITH b AS (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS block FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS p FROM documents))
    SELECT doc_id, block, CASE WHEN regexp_matches(t, '^(?:\*\s*){{3,}}$|^(?:-\s*){{3,}}$|^(?:_\s*){{3,}}$|^#$') THEN 'scene_break'
      WHEN regexp_matches(t, '(?i)^(?:#{{1,6}}\s+\S[^\n]*|(?:chapter|book|part|volume|act|scene|prologue|epilogue)\b[^.!?]{{0,80}})$') THEN 'heading'
      WHEN regexp_matches(t, '(?i)^(?:dear|my dear)\b[^\n]{{0,60}}[,:—]') THEN 'letter' WHEN regexp_matches(t, '^(?:[-*•]\s+|\d{{1,3}}[.)]\s+)\S') THEN 'list' ELSE 'prose' END AS kind, sha256(t) AS digest FROM b""",
)
def block_rows(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.posexplode(text.blocks(F.col("text"), "\n")).alias("_k", "_b"))
    return found.select("doc_id", (F.col("_k") + 1).cast("long").alias("block"), "_b.kind", F.sha2("_b.text", 256).alias("digest"))


# --- chunks and their ledger


TAILS = """chunks AS (SELECT doc_id, CAST((k - 1) / 100 AS BIGINT) + 1 AS chunk, array_to_string(w[k:k + 99], ' ') AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 100)) AS k FROM
  (SELECT doc_id, list_filter(regexp_split_to_array(text, '""" + WS + """+'), lambda w: w <> '') AS w FROM documents)))"""


@query("chunk_tails", f"WITH {TAILS} SELECT doc_id, chunk, sha256(right(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), 800)) AS tail FROM chunks")
def chunk_tails(spark, d):
    found = formatting.with_tails(formatting.word_chunks(table(spark, d, "documents"), size=100))
    return found.select("doc_id", "chunk", F.sha2("tail", 256).alias("tail"))


@query("resumed_chunks", f"WITH {TAILS} SELECT doc_id, chunk, sha256(coalesce(right(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), 800), '') || body) AS digest FROM chunks")
def resumed_chunks(spark, d):
    """Chunks worked on in a stream that stops in its second batch, goes on, and then begins anew without its checkpoint."""
    folder = fresh(spark, "chunks")
    pieces = formatting.with_tails(formatting.word_chunks(table(spark, d, "documents"), size=100))
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))  # in four batches or fewer
    pieces.repartition(files, "doc_id").write.parquet(f"{folder}/pieces")
    book = ledger.Ledger(spark, f"{folder}/ledger", ["doc_id", "chunk"], "doc_id long, chunk long, digest string")
    calls = []

    def work(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return batch.select("doc_id", "chunk", F.sha2(F.concat(F.coalesce("tail", F.lit("")), "text"), 256).alias("digest"))

    for checkpoint in ("one", "one", "other"):
        source = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/pieces")
        try:
            book.run(source, f"{folder}/{checkpoint}", work).awaitTermination()
        except Exception:
            if len(calls) != 2:
                raise
    return book.finished()


# --- events


@query(
    "dashboard",
    f"""WITH {READINGS}, {BOOKS}, t AS (SELECT *, TIMESTAMP '{EVENT_NOW}' - INTERVAL 12 HOURS AS now FROM readings)
    SELECT count(*) FILTER (w AND event_type = 'book_view') AS views, count(*) FILTER (w AND event_type = 'offline_download') AS downloads, count(*) FILTER (w AND event_type = 'chapter_complete' AND chapter_number = 1) AS first_chapter_completions,
      count(*) FILTER (w AND event_type = 'chapter_start' AND chapter_number = 3) AS third_chapter_starts, count(DISTINCT nullif(coalesce(user_id, anonymous_id), '')) FILTER (created_at >= date_trunc('day', now) AND created_at <= now) AS readers_today,
      (SELECT count(*) FROM books WHERE status = 'published') AS published
    FROM (SELECT *, created_at >= now - INTERVAL 7 DAYS AND created_at <= now AS w FROM t)""",
)
def dashboard(spark, d):
    return events.dashboard(reading_events(spark, d), books(spark, d), "2024-01-30 12:00:00")


def sent(spark, d, shift_days: int = 0):
    """The reading events as rows of a stream."""
    at = F.col("created_at") + F.make_dt_interval(F.lit(shift_days))
    return reading_events(spark, d).select("event_id", at.alias("created_at"), "user_id", "anonymous_id", "event_type", F.col("book_id").cast("long").alias("book_id"), "chapter_number", F.col("value").cast("long").alias("reading_seconds"))


def arrivals(spark, d, folder, parts: int):
    """Writes the reading events into a stream's folder part by part in order of time, a pause after each: what is there then is a batch.

    A part is written by all tasks. With the last comes an event long after all others: the watermark passes what is still waited for.
    """
    rows = sent(spark, d)
    low, high = rows.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    part = F.lit(0) if low is None else F.floor((F.unix_micros("created_at") - F.lit(low)) * parts / F.lit(high - low + 1))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp").alias("created_at"), F.lit("closing").alias("user_id"), F.lit("").alias("anonymous_id"), F.lit("book_view").alias("event_type"), F.lit(None).cast("long").alias("book_id"), F.lit(1).alias("chapter_number"), F.lit(1).cast("long").alias("reading_seconds"))
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
        if k == parts - 1:
            last.write.mode("append").parquet(folder)
        yield k


def watched(spark, folder):
    return spark.readStream.schema(stream.EVENT_SCHEMA).parquet(folder)


@query(
    "monthly_runs",
    f"""WITH {READINGS}, e AS (SELECT event_id, created_at + INTERVAL 12 DAYS AS moved FROM readings), m AS (SELECT CAST(date_trunc('month', moved) AS DATE) AS period_start, event_id % 2 = 0 AS early FROM e)
    SELECT period_start, CASE WHEN period_start = DATE '2024-01-01' THEN 'sent' ELSE 'open' END AS status, CAST(CASE WHEN period_start = DATE '2024-01-01' THEN count(*) FILTER (early) ELSE 0 END AS BIGINT) AS rolled_up,
      CAST(CASE WHEN period_start = DATE '2024-01-01' THEN count(*) FILTER (NOT early) ELSE 0 END AS BIGINT) AS late, CAST(CASE WHEN period_start = DATE '2024-01-01' THEN count(*) FILTER (early) ELSE count(*) END AS BIGINT) AS open FROM m GROUP BY 1""",
)
def monthly_runs(spark, d):
    """Half of the events, a month closed, and the other half: those of the closed month come too late."""
    folder = fresh(spark, "months")
    rows = sent(spark, d, 12)
    for name, rest in (("first", 0), ("second", 1)):
        rows.where(F.col("event_id") % 2 == rest).repartition(2).write.parquet(f"{folder}/{name}")
    book = reports.MonthlyReports(spark, f"{folder}/book")
    book.ingest(watched(spark, f"{folder}/first"), f"{folder}/c1").awaitTermination()
    book.close("2024-01-01", "2024-02-01", lambda rollups: None)
    book.ingest(watched(spark, f"{folder}/second"), f"{folder}/c2").awaitTermination()
    return book.summary()


@query(
    "streamed_throttle",
    f"""WITH RECURSIVE {READINGS}, keyed AS (SELECT event_id, CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'anonymous:' || anonymous_id END AS key, created_at FROM readings WHERE user_id IS NOT NULL OR anonymous_id <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, event_id) AS k FROM keyed),
    steps AS (SELECT event_id, key, k, created_at AS last, TRUE AS kept FROM numbered WHERE k = 1
      UNION ALL SELECT n.event_id, n.key, n.k, CASE WHEN s.last < n.created_at - INTERVAL 6 HOURS THEN n.created_at ELSE s.last END, s.last < n.created_at - INTERVAL 6 HOURS FROM steps s JOIN numbered n ON n.key = s.key AND n.k = s.k + 1)
    SELECT key, event_id, CASE WHEN kept THEN 'accepted' ELSE 'refused' END AS verdict FROM steps""",
)
def streamed_throttle(spark, d):
    """A stream of events in several batches: of each reader at most one event in six hours."""
    folder = fresh(spark, "throttle")
    for _ in arrivals(spark, d, f"{folder}/in", 2):
        verdicts = readers.throttled(watched(spark, f"{folder}/in"), 6 * 3600, "10 minutes")
        readers.write_verdicts(verdicts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/verdicts").where("event_id >= 0").select("key", "event_id", "verdict")


@query(
    "streamed_debounce",
    f"""WITH {READINGS}, keyed AS (SELECT event_id, CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'anonymous:' || anonymous_id END AS key, created_at FROM readings WHERE user_id IS NOT NULL OR anonymous_id <> ''),
    n AS (SELECT *, lead(created_at) OVER (PARTITION BY key ORDER BY created_at, event_id) AS following FROM keyed) SELECT key, event_id FROM n WHERE following IS NULL OR epoch_ms(following) - epoch_ms(created_at) >= 3600000""",
)
def streamed_debounce(spark, d):
    """A stream of events in several batches: those after which a reader is silent for an hour, the last one of each too."""
    folder = fresh(spark, "debounce")
    for _ in arrivals(spark, d, f"{folder}/in", 2):
        quiet = readers.debounced(watched(spark, f"{folder}/in"), events.reader_key(), 3_600_000, "10 minutes")
        readers.write_verdicts(quiet, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/verdicts").where("event_id >= 0").select("key", "event_id")
