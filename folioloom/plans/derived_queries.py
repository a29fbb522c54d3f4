"""Rules on paths, requests, titles, metadata and readers' files, over inputs that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import codes, text
from folioloom.operators import audit, events, ingest, publish

from .book_queries import chapters
from .stand_ins import BOOKS, CHAPTERS, books, dealt, table

QUERIES, ORACLE_SQL = {}, {}
#: ECMAScript white space in DuckDB's regular expressions.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return keep


def picked(values: list[str], k, of: int | None = None):
    """The value for ``k``, in turn."""
    return F.get(F.array(*[F.lit(v) for v in values]), (k % (of or len(values))).cast("int"))


def in_turn(values: list[str], k: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[1 + {k} % {len(values)}]"


# --- paths

FOLDERS = ["shelf", "s4_backup_a", "Archive-2", ".agent", "pre s7", "research notes", "mobile_moon_work", "oldest", ".moon.mobile_work", "Do Not Publish", "workbook", "a.reports"]
NAMES = ["_final_en.md", "_final_sw.txt", "_draft.md", ".md", "_chapters_2.md", "_outline.md", ".docx", "_full_story_final.md", "_full_review.md"]
FILES = f"""files AS (SELECT p_partkey, p_size, '/' || {in_turn(FOLDERS, 'p_partkey')} || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'mobile_' ELSE '' END || replace(p_name, ' ', '_') || {in_turn(NAMES, 'p_size')} AS path FROM part)"""
EXCLUDED = r"""len(list_filter(regexp_split_to_array(path, '[/\\]+'), lambda x: regexp_matches(x, '(?i)^(?:\..+\.mobile_work|mobile_.+_work)$') OR regexp_matches(x, '(?i)(?:^|[_. -])(?:backup|archive|old|publication|pre[_ -]?s\d|mobile[_ .-]?work|reports?|audit|outline|planning|research|design|prompts?|video|\.agent|\.reasonix)(?:$|[_. -])')
  OR regexp_matches(x, '(?i)禁止发布|隔离|do[_ -]?not[_ -]?publish|写作中转'))) > 0"""


def files(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("/"), picked(FOLDERS, k), F.lit("/"), F.when(k % 5 == 0, "mobile_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), picked(NAMES, n))
    return table(spark, d, "part").select("p_partkey", "p_size", path.alias("path"))


@query("excluded_paths", f"WITH {FILES} SELECT p_partkey, path, {EXCLUDED} AS excluded FROM files")
def excluded_paths(spark, d):
    return files(spark, d).select("p_partkey", "path", audit.excluded_path(F.col("path")).alias("excluded"))


@query(
    "manuscript_scores",
    rf"""WITH {FILES}, l AS (SELECT *, lower(path) AS low FROM files) SELECT p_partkey, CASE WHEN regexp_matches(low, '\.(?:md|txt)$') AND NOT {EXCLUDED} AND NOT regexp_matches(low, 'report|audit|outline|bible|concept|synopsis|ledger|notes|readme|validation|prompt|narration')
      AND NOT regexp_matches(low, '(?:^|[_ .-])(?:draft|review|qa)(?:[_ .-]|\.(?:md|txt)$)') AND NOT regexp_matches(low, 'full[_ .-]?review')
    THEN 100 * contains(low, 'mobile_')::INT + 50 * contains(low, 'final')::INT + 50 * regexp_matches(low, '_final_(?:en|sw)|_(?:en|sw)_final')::INT + 20 * contains(low, 'full_story')::INT + 5 * regexp_matches(low, 'chapters?_\d')::INT + 5 * ends_with(low, '.md')::INT END AS score FROM l""",
)
def manuscript_scores(spark, d):
    return files(spark, d).select("p_partkey", audit.manuscript_score(F.col("path")).cast("int").alias("score"))


PICTURES = ["cover_en.jpg", "cover.png", "swahili-cover.webp", "english.jpeg", "moon_sw.png", "promo_cover.jpg", "cover.gif", "contact-sheet.png", "Cover.SW.JPG"]
COVERS = f"""covers AS (SELECT p_partkey, 'b' || p_partkey // 4 AS folder, 'b' || p_partkey // 4 || '/' || {in_turn(PICTURES, '(p_size + p_partkey)')} AS path FROM part), scored AS (
  SELECT *, CASE WHEN regexp_matches(lower(path), '\\.(?:jpe?g|png|webp)$') AND NOT regexp_matches(lower(path), 'promo|video|frame|caption|contact.sheet') THEN
    30 * contains(name, 'cover')::INT + 50 * (regexp_matches(name, '(?:^|[_\\-.])' || language || '(?:[_\\-.]|$)') OR contains(name, spelled))::INT - 100 * regexp_matches(name, '(?:^|[_\\-.])' || other || '(?:[_\\-.]|$)')::INT + 5 * regexp_matches(name, '\\.jpe?g$')::INT END AS score
  FROM (SELECT *, lower(string_split(path, '/')[2]) AS name FROM covers), (VALUES ('en', 'sw', 'english'), ('sw', 'en', 'swahili')) AS v(language, other, spelled))"""


def pictures(spark, d):
    k = F.col("p_partkey")
    folder = F.concat(F.lit("b"), F.floor(k / 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", folder.alias("folder"), F.concat(folder, F.lit("/"), picked(PICTURES, F.col("p_size") + k)).alias("path"))


@query("cover_scores", f"WITH {COVERS} SELECT p_partkey, path, max(score) FILTER (language = 'en') AS en, max(score) FILTER (language = 'sw') AS sw FROM scored GROUP BY 1, 2")
def cover_scores(spark, d):
    return pictures(spark, d).select("p_partkey", "path", *[audit.cover_score(F.col("path"), code).cast("int").alias(code) for code in ("en", "sw")])


@query("best_covers", f"WITH {COVERS} SELECT folder, language, path, score FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder, language ORDER BY score DESC, path) = 1")
def best_covers(spark, d):
    return audit.best_covers(pictures(spark, d)).select("folder", "language", "path", F.col("score").cast("int").alias("score"))


# --- requests and events

KINDS = ["book_view", "chapter_start", "chapter_50", "chapter_complete", "bookshelf_add", "offline_download", "glance", ""]
SECONDS = ["", ',"readingSeconds":12', ',"readingSeconds":1.5', ',"readingSeconds":-3', ',"readingSeconds":null', ',"readingSeconds":"7"', ',"readingSeconds":86401', ',"readingSeconds":86400']
UUID_HEAD = "12121212-3434-4565-8787-"


@query(
    "request_outcomes",
    f"""WITH r AS (SELECT event_id, {in_turn(KINDS, 'event_id')} AS kind, event_id % 11 AS book, event_id % 13 AS chapter, event_id // 8 % 8 AS seconds, event_id % 17 AS shape, event_id % 3 AS account, event_id % 7 AS reader FROM events)
    SELECT event_id, CASE WHEN shape = 3 THEN 'too large' WHEN shape = 5 THEN 'not JSON' WHEN shape = 7 THEN 'invalid event'
      WHEN kind IN ('glance', '') OR book IN (2, 4) OR chapter = 6 OR (chapter = 8 AND kind NOT IN ('book_view', 'bookshelf_add')) OR seconds IN (2, 3, 5, 6) THEN 'invalid event'
      WHEN account <> 0 AND reader = 1 THEN 'invalid reader' END AS outcome FROM r""",
)
def request_outcomes(spark, d):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    uuid = F.concat(F.lit(UUID_HEAD), F.lpad(user, 12, "0"))
    book = F.when(k % 11 == 2, '"a-book"').when(k % 11 == 4, "9").otherwise(F.concat(F.lit('"'), F.upper(uuid), F.lit('"')))
    chapter = F.when(k % 13 == 6, '"12-34"').when(k % 13 == 8, "null").otherwise(F.concat(F.lit('"'), uuid, F.lit('"')))
    reader = F.when(k % 7 == 1, F.concat(F.lit("reader "), user)).otherwise(F.concat(F.lit("  "), uuid))
    body = F.concat(F.lit('{"eventType":"'), picked(KINDS, k), F.lit('","bookId":'), book, F.lit(',"chapterId":'), chapter, F.lit(',"anonymousId":"'), reader, F.lit('"'), picked(SECONDS, F.floor(k / 8)), F.lit("}"))
    shaped = F.when(k % 17 == 3, F.concat(F.repeat(F.lit(" "), 4096), body)).when(k % 17 == 5, F.concat(body, F.lit("]"))).when(k % 17 == 7, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    rows = dealt(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", shaped.alias("body"), F.when(k % 3 == 0, user).alias("user_id"))
    return events.request_outcomes(rows).select("event_id", "outcome")


@query("scroll_shares", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 100 ELSE greatest(0, least(100, floor((value * 11 - 40) / (event_id % 7 * 150.0) * 100 + 0.5))) END AS INTEGER) AS percent FROM events")
def scroll_shares(spark, d):
    return table(spark, d, "events").select("event_id", events.scroll_percent(F.col("value") * 11 - 40, F.col("event_id") % 7 * F.lit(150.0)).alias("percent"))


@query("report_windows", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS period_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_end FROM orders")
def report_windows(spark, d):
    """The month that a report of each day is about."""
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    start, end = events.month_window(F.col("day"))
    return days.select("day", start.alias("period_start"), end.alias("period_end"))


# --- audits

@query(
    "environment_lines",
    """WITH l AS (SELECT c_custkey AS position, 'KEY_' || c_nationkey || '_' || c_mktsegment AS key, c_custkey % 6 AS shape, c_name AS v FROM customer)
    SELECT key, CASE shape WHEN 0 THEN v WHEN 1 THEN ' ' || v || ' ' WHEN 2 THEN v || ' = x' WHEN 3 THEN '' ELSE v END AS value FROM l WHERE shape < 5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY position % 2 DESC, position DESC) = 1""",
)
def environment_lines(spark, d):
    """Lines of two files: those of the second, of odd position, take precedence; within a file the last."""
    k, key, value = F.col("c_custkey"), F.concat(F.lit("KEY_"), F.col("c_nationkey").cast("string"), F.lit("_"), "c_mktsegment"), F.col("c_name")
    line = (
        F.when(k % 6 == 0, F.concat(F.lit("export "), key, F.lit("="), value))
        .when(k % 6 == 1, F.concat(F.lit("  "), key, F.lit(' = " '), value, F.lit(' "')))
        .when(k % 6 == 2, F.concat(key, F.lit("="), value, F.lit(" = x")))
        .when(k % 6 == 3, F.concat(key, F.lit("=")))
        .when(k % 6 == 4, F.concat(key, F.lit("='"), value, F.lit("'")))
        .otherwise(F.concat(F.lit("# "), key, F.lit("="), value))
    )
    return audit.environment(table(spark, d, "customer").select(F.struct((k % 2).alias("file"), k.alias("line")).alias("position"), line.alias("line")))


@query(
    "response_states",
    """SELECT c_custkey AS slug, CASE WHEN c_custkey % 9 = 0 THEN 'error' WHEN c_custkey % 5 < 3 THEN 'ok' WHEN c_custkey % 5 = 3 THEN 'http-' || (400 + c_nationkey) ELSE 'http-none' END AS state,
    CASE WHEN c_custkey % 9 = 0 OR c_custkey % 5 >= 3 OR c_custkey % 5 = 2 THEN 0 ELSE c_custkey % 4 END AS found FROM customer""",
)
def response_states(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"books":['), F.array_join(F.array_repeat(F.lit('{"slug":"x"}'), (k % 4).cast("int")), ","), F.lit("]}"))
    status = F.when(k % 5 < 3, (k % 5 + 200).cast("int")).when(k % 5 == 3, F.col("c_nationkey") + 400)
    rows = table(spark, d, "customer").select(k.alias("slug"), status.alias("status"), F.when(k % 5 == 2, "").otherwise(body).alias("body"), F.when(k % 9 == 0, "timed out").alias("error"))
    return audit.response_rows(rows).withColumn("found", F.col("found").cast("long"))


@query(
    "retry_waits",
    """SELECT event_id, CAST(CASE WHEN event_id % 6 + 1 < 5 AND event_id % 4 <> 1 THEN CASE WHEN event_id % 5 = 0 THEN least(15000, user_id * 1000) ELSE least(8000, 500 * pow(2, event_id % 6)) END END AS BIGINT) AS wait_ms FROM events""",
)
def retry_waits(spark, d):
    k = F.col("event_id")
    status = F.when(k % 4 == 0, 503).when(k % 4 == 1, 404).when(k % 4 == 2, 429)
    rows = table(spark, d, "events").select("event_id", (k % 6 + 1).cast("int").alias("attempt"), status.alias("status"), F.when(k % 5 == 0, F.col("user_id")).alias("retry_after_seconds"))
    return audit.retry_waits(rows).select("event_id", "wait_ms")


# --- texts

LATIN = "translate(regexp_replace(lower(text), '[\\x{0300}-\\x{036f}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query("slug_latin", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace({LATIN}, '^{WS}+|{WS}+$', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS digest FROM documents")
def slug_latin(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.slugify_latin(F.col("text")), 256).alias("digest"))


@query("script_safe", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS digest FROM pages")
def script_safe(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.script_safe(F.col("html")), 256).alias("digest"))


@query("title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-' || upper(lower(p_brand)[1]) || lower(p_brand)[2:] AS title FROM part")
def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_case(F.concat(F.upper("p_name"), F.lit(" "), "p_type", F.lit("-"), "p_brand")).alias("title"))


@query("category_labels", "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment)[2:] || '-Nation-' || c_nationkey AS label FROM customer")
def category_labels(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.title_case(F.replace(F.concat("c_mktsegment", F.lit("_nation_"), F.col("c_nationkey").cast("string")), F.lit("_"), F.lit("-"))).alias("label"))


@query("dotted_times", "SELECT event_id, 'At ' || strftime(ts, '%H') || '.' || strftime(ts, '%M') || '.' || strftime(ts, '%S') || ': ' || event_type || ':1' AS heading FROM events")
def dotted_times(spark, d):
    return table(spark, d, "events").select("event_id", text.dotted_times(F.concat(F.lit("At "), F.date_format("ts", "HH:mm:ss"), F.lit(": "), "event_type", F.lit(":1"))).alias("heading"))


HEADS = ["Chapter {}: ", "CHAPTER {} - ", "Sura ya {} — ", "sura {}： ", "Chapter {} ", "The Chapter {}: "]


@query("display_titles", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 4 THEN 'Chapter ' || l_linenumber || ' ' WHEN 5 THEN 'The Chapter ' || l_linenumber || ': ' ELSE '' END || 'Ship ' || l_returnflag AS title FROM lineitem")
def display_titles(spark, d):
    parts = F.split(picked(HEADS, F.col("l_partkey")), "\\{\\}")
    title = F.concat(F.element_at(parts, 1), F.col("l_linenumber").cast("string"), F.element_at(parts, 2), F.lit("Ship "), "l_returnflag")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.display_title(title).alias("title"))


@query("first_paragraph", f"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_split_to_array(text, '\\n\\s*\\n')[1], '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g'), 1, 320) AS summary FROM documents")
def first_paragraph(spark, d):
    return table(spark, d, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("detail_synopsis", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || chr(10) || p_type WHEN 1 THEN 'mji wa ' || p_brand ELSE '' END AS synopsis FROM part")
def detail_synopsis(spark, d):
    k, line = F.col("p_partkey"), F.lit("\n")
    first = F.concat(F.lit("# Notes\n## Version A\nleft out\n## Version B (long)\n> "), "p_name", F.lit("\n\n---\n  "), "p_type", F.lit("\n## Next\nmore"))
    second = F.concat(F.lit("## Toleo B\n>mji wa "), "p_brand", line)
    return table(spark, d, "part").select("p_partkey", text.detail_synopsis(F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(F.concat(F.lit("# Version B\n"), "p_name"))).alias("synopsis"))


@query("plain_markup", r"SELECT conv_id, turn, sha256(regexp_replace(repeat('#', 1 + turn % 8) || ' ' || replace(text, '. ', chr(10) || '## '), '(?m)^#{1,6}[ \t]+', '', 'g')) AS digest FROM conversations")
def plain_markup(spark, d):
    marked = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 8 + 1).cast("int")), F.lit(" "), F.replace("text", F.lit(". "), F.lit("\n## ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.strip_markup(marked), 256).alias("digest"))


@query("words_in_thousands", f"SELECT source, CAST(floor(sum(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))) / 1000 + 0.5) AS BIGINT) || 'k words' AS label FROM documents GROUP BY 1")
def words_in_thousands(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(text.word_count(F.col("text"))).alias("_n")).select("source", text.thousands(F.col("_n")).alias("label"))


@query(
    "roman_numerals",
    """SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 3999 THEN repeat('M', o_orderkey // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][1 + o_orderkey // 100 % 10] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][1 + o_orderkey // 10 % 10]
    || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][1 + o_orderkey % 10] END AS numeral FROM orders""",
)
def roman_numerals(spark, d):
    return table(spark, d, "orders").select("o_orderkey", codes.roman(F.col("o_orderkey")).alias("numeral"))


@query("rolling_hashes", "SELECT page_id, abs(list_reduce(list_transform(range(1, length(url) + 1), lambda i: CAST(ascii(url[i]) AS BIGINT)), lambda h, x: ((h * 31 + x + 2147483648) & 4294967295) - 2147483648, CAST(0 AS BIGINT))) AS hash FROM pages")
def rolling_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", codes.rolling_hash(F.col("url")).alias("hash"))


@query("masked_texts", "SELECT conv_id, turn, sha256(text) AS unmasked, text <> '' AS hidden FROM conversations")
def masked_texts(spark, d):
    key = F.col("turn") % 254 + 1
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", codes.masked(F.col("text"), key).alias("m"))
    return rows.select("conv_id", "turn", F.sha2(codes.unmasked(F.col("m"), key), 256).alias("unmasked"), (F.col("m") != F.col("text")).alias("hidden"))


@query(
    "cover_addresses",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.store.example/render/public/' || page_id || '.png?v=' || page_id % 9 || '&width=240&resize=contain&quality=76' WHEN 1 THEN 'http://b.store.example/render/public/' || page_id || '.png?width=240&resize=contain&quality=76'
    WHEN 2 THEN 'https://store.example.net/object/public/' || page_id || '.png' ELSE url END AS address FROM pages""",
)
def cover_addresses(spark, d):
    k, file = F.col("page_id"), F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    address = F.when(k % 4 == 0, F.concat(F.lit("https://a.store.example/object/public/"), file, F.lit("?x=1&v="), (k % 9).cast("string"))).when(k % 4 == 1, F.concat(F.lit("http://b.store.example/object/public/"), file)).when(k % 4 == 2, F.concat(F.lit("https://store.example.net/object/public/"), file)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.cover_address(address, 240, ".store.example", "/object/public/", "/render/public/").alias("address"))


@query(
    "site_addresses",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://site.example/read/' || page_id WHEN page_id % 3 = 1 THEN CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN url ELSE 'https://site.example/none.png' END ELSE 'https://site.example/none.png' END AS address,
    CASE WHEN page_id % 3 = 0 THEN '/read/' || page_id END AS own_path FROM pages""",
)
def site_addresses(spark, d):
    k = F.col("page_id")
    given = F.when(k % 3 == 0, F.concat(F.lit("/read/"), k.cast("string"))).when(k % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("data:image/png,"), F.col("url")))
    made = text.absolute_address(given, "https://site.example", "/none.png")
    return table(spark, d, "pages").select("page_id", made.alias("address"), text.own_path(F.when(k % 3 == 0, made).otherwise(F.col("url")), "https://site.example").alias("own_path"))


@query("prompt_sizes", "SELECT doc_id, sha256('Tell it again.' || chr(10) || chr(10) || substr(text, 1, 1500) || chr(10) || chr(10) || substr(lang || ': ' || text, 1, 300)) AS digest FROM documents")
def prompt_sizes(spark, d):
    asked = F.concat("lang", F.lit(": "), "text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.prompt("Tell it again.", F.col("text"), asked), 256).alias("digest"))


# --- metadata

PARTS = "meta AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' ELSE p_name END AS title, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS author, CASE p_size % 3 WHEN 0 THEN '' ELSE p_type END AS description, CASE p_size % 7 WHEN 0 THEN NULL ELSE 'c.png' END AS cover, ['en', 'sw', 'fr', NULL][1 + p_partkey % 4] AS language FROM part)"


def metadata(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.when(k % 4 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("p_brand")).alias("author"),
        F.when(n % 3 == 0, "").otherwise(F.col("p_type")).alias("description"), F.when(n % 7 == 0, None).otherwise("c.png").alias("cover"), F.when(k % 4 == 0, "en").when(k % 4 == 1, "sw").when(k % 4 == 2, "fr").alias("language"),
    )


@query("first_filled", f"WITH {PARTS} SELECT p_partkey, coalesce(nullif(author, ''), nullif(description, ''), title) AS label FROM meta")
def first_filled(spark, d):
    return metadata(spark, d).select("p_partkey", ingest.first_filled(F.col("author"), F.col("description"), F.col("title")).alias("label"))


@query("missing_metadata", f"WITH {PARTS} SELECT p_partkey, concat_ws(',', CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN coalesce(author, '') = '' THEN 'author' END, CASE WHEN description = '' THEN 'description' END, CASE WHEN cover IS NULL THEN 'cover' END, CASE WHEN language IS NULL OR language NOT IN ('en', 'sw') THEN 'language (en or sw)' END) AS missing FROM meta")
def missing_metadata(spark, d):
    return metadata(spark, d).select("p_partkey", F.array_join(ingest.missing_metadata(*[F.col(c) for c in ("title", "author", "description", "cover", "language")]), ",").alias("missing"))


@query("classified_titles", "SELECT p_partkey, CASE WHEN p_name IN ('small ring', 'red widget') THEN 'Thriller' WHEN p_name IN ('red widget', 'blue bolt', 'hot gear') THEN 'Romance' ELSE 'Contemporary' END AS category, concat_ws(',', CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' END, CASE WHEN ends_with(p_name, 'gear') THEN 'machine' END) AS tags FROM part")
def classified_titles(spark, d):
    found = ingest.classify(F.col("p_name"), {"Thriller": ["small ring", "red widget"], "Romance": ["red widget", "blue bolt", "hot gear"]}, "Contemporary", [("colour", "red|blue"), ("machine", "gear$")])
    return table(spark, d, "part").select("p_partkey", found["category"].alias("category"), F.array_join(found["tags"], ",").alias("tags"))


@query("first_published", "SELECT o_orderkey, CASE WHEN s_suppkey IS NULL THEN 'Publication year unknown' ELSE 'First published ' || (1800 + s_nationkey) END AS label FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def first_published(spark, d):
    """Labels out of a table of years, by title; books that it does not have get a default."""
    years = table(spark, d, "supplier").select(F.col("s_suppkey").alias("title"), (F.col("s_nationkey") + 1800).alias("year"))
    return ingest.first_publication(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("title")), years).select("o_orderkey", "label")


@query("local_chapters", "SELECT event_id FROM events WHERE event_id % 6 <> 5 AND CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN floor(value) WHEN 2 THEN pow(2, 53) - event_id % 3 + 1 ELSE NULL END BETWEEN 1 AND 9007199254740991 AND (event_id % 4 <> 0 OR value = floor(value))")
def local_chapters(spark, d):
    k = F.col("event_id")
    number = F.when(k % 4 == 0, F.col("value")).when(k % 4 == 1, F.floor("value").cast("double")).when(k % 4 == 2, F.lit(2.0**53) - k % 3 + 1)
    rows = table(spark, d, "events").select("event_id", number.alias("number"), F.when(k % 6 != 5, F.col("props")).alias("content"))
    return ingest.local_chapters(rows).select("event_id")


# --- readers' files


@query(
    "read_manifests",
    f"""WITH {BOOKS}, {CHAPTERS}, n AS (SELECT book_id, list(chapter_number ORDER BY chapter_number) AS listed FROM chapters WHERE chapter_number >= 1 GROUP BY 1)
    SELECT book_id, slug, array_to_string(CASE WHEN id % 5 = 0 THEN list_filter(listed, lambda x: x <> 1) ELSE listed END, ',') AS numbers, id % 5 <> 0 OR NOT list_contains(listed, 1) AS complete FROM n JOIN books ON id = book_id WHERE id % 7 <> 0""",
)
def read_manifests(spark, d):
    """Manifests as written, read again: of some books a chapter's address is another book's, of some the version is none that is known."""
    made = publish.manifest(books(spark, d), chapters(spark, d))
    k, slug = F.col("book_id"), F.get_json_object("manifest", "$.book.slug")
    path = F.replace("manifest", F.lit(publish.SITE), F.lit(""))
    other = F.replace(path, F.concat(F.lit("/read/"), slug, F.lit('/1"')), F.lit('/read/else/1"'))
    broken = F.when(k % 7 == 0, F.replace(path, F.lit('"schemaVersion":1'), F.lit('"schemaVersion":2'))).when(k % 5 == 0, other).otherwise(path)
    found = publish.read_manifest(made.select("book_id", broken.alias("manifest")))
    return found.select("book_id", "book.slug", F.array_join(F.transform("chapters", lambda c: c["number"].cast("string")), ",").alias("numbers"), "complete")


@query(
    "read_chapters",
    f"""SELECT conv_id, turn, CASE WHEN good THEN CASE WHEN turn % 3 = 0 THEN 'Turn ' || turn ELSE 'Chapter ' || turn END END AS title, CASE WHEN good THEN sha256(array_to_string(CASE WHEN turn % 2 = 0 THEN ['p', text] ELSE list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') END, '|')) END AS digest
    FROM (SELECT *, turn % 5 <> 4 AND conv_id % 6 <> 5 AND regexp_replace(text, '{WS}', '', 'g') <> '' AS good FROM conversations)""",
)
def read_chapters(spark, d):
    """Chapter records as JSON: with paragraphs or without, of the wrong number, of another book."""
    k, n = F.col("conv_id"), F.col("turn")
    chapter = F.struct(F.lit("i").alias("id"), F.when(n % 5 == 4, n + 1).otherwise(n).alias("number"), F.when(n % 3 == 0, F.concat(F.lit("Turn "), n.cast("string"))).alias("title"), F.col("text").alias("content"), F.when(n % 2 == 0, F.array(F.lit("p"), F.col("text"))).alias("paragraphs"))
    book = F.struct(F.when(k % 6 == 5, "other").otherwise(F.concat(F.lit("conv-"), k.cast("string"))).alias("slug"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), book.alias("book"), chapter.alias("chapter"))).alias("record"))
    got = publish.read_chapter(rows, F.concat(F.lit("conv-"), k.cast("string")), n)
    return got.select("conv_id", "turn", F.col("chapter.title").alias("title"), F.sha2(F.array_join("chapter.paragraphs", "|"), 256).alias("digest"))
