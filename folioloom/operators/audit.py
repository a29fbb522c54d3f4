"""Release audits: source choice, counts, drift between expected and actual state, asset limits."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.sources.shared import written

from .catalog import top_of_each

MAX_FILES, MAX_FILE_BYTES = 20_000, 25 << 20

#: Fixed patterns: names of folders and files that no manuscript comes from, and words of files that are none.
WORK_PART = "(?i)^(?:\\..+\\.mobile_work|mobile_.+_work)$"
EXCLUDED_PART = "(?i)(?:^|[_. -])(?:backup|archive|old|publication|pre[_ -]?s\\d|mobile[_ .-]?work|reports?|audit|outline|planning|research|design|prompts?|video|\\.agent|\\.reasonix)(?:$|[_. -])"
BLOCKED_PART = "(?i)禁止发布|隔离|do[_ -]?not[_ -]?publish|写作中转"
NO_MANUSCRIPT = "report|audit|outline|bible|concept|synopsis|ledger|notes|readme|validation|prompt|narration"
#: Fixed patterns: pictures, and words of pictures that are no covers.
PICTURE, NO_COVER = "\\.(?:jpe?g|png|webp)$", "promo|video|frame|caption|contact.sheet"


def excluded_path(path: Column) -> Column:
    return F.exists(F.split(path, "[/\\\\]+"), lambda part: part.rlike(WORK_PART) | part.rlike(EXCLUDED_PART) | part.rlike(BLOCKED_PART))


def cover_score(path: Column, language: str) -> Column:
    """How likely a picture is the cover of an edition in ``language``; null if it cannot be."""
    lower = F.lower(path)
    name = F.element_at(F.split(lower, "/"), -1)
    marked = {code: name.rlike(f"(?:^|[_\\-.]){code}(?:[_\\-.]|$)") for code in ("en", "sw")}
    spelled = {"en": name.rlike("english"), "sw": name.rlike("swahili")}
    other = "sw" if language == "en" else "en"
    points = [(name.rlike("cover"), 30), (marked[language] | spelled[language], 50), (marked[other], -100), (name.rlike("\\.jpe?g$"), 5)]
    return F.when(lower.rlike(PICTURE) & ~lower.rlike(NO_COVER), sum((F.when(holds, worth).otherwise(0) for holds, worth in points), F.lit(0)))


def best_covers(files: DataFrame) -> DataFrame:
    """(folder, language, path, score) of the likeliest cover of each folder in each language; ties by path."""
    each = F.explode(F.array(*[F.struct(F.lit(code).alias("language"), cover_score(F.col("path"), code).alias("score")) for code in ("en", "sw")]))
    scored = files.select("folder", "path", each.alias("_s")).select("folder", "path", "_s.*").where("score is not null")
    return top_of_each(scored, ["folder", "language"], [F.desc("score"), F.col("path")])


def manuscript_score(path: Column) -> Column:
    """How likely a file is the final manuscript; null if it cannot be."""
    lower = F.lower(path)
    points = [("mobile_", 100), ("final", 50), ("_final_(?:en|sw)|_(?:en|sw)_final", 50), ("full_story", 20), ("chapters?_\\d", 5), ("\\.md$", 5)]
    score = sum((F.when(lower.rlike(pattern), worth).otherwise(0) for pattern, worth in points), F.lit(0))
    draft = lower.rlike("(?:^|[_ .-])(?:draft|review|qa)(?:[_ .-]|\\.(?:md|txt)$)") | lower.rlike("full[_ .-]?review")
    usable = lower.rlike("\\.(?:md|txt)$") & ~excluded_path(path) & ~lower.rlike(NO_MANUSCRIPT) & ~draft
    return F.when(usable, score)


def best_sources(files: DataFrame) -> DataFrame:
    """The best manuscript of each (folder, language): greatest score, then least path."""
    scored = files.withColumn("score", manuscript_score(F.col("path"))).where("score is not null")
    return top_of_each(scored, ["folder", "language"], [F.desc("score"), F.col("path")])


def release_counts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each book with its chapters, published ones, and its parent's slug."""
    counts = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("_n"), F.count_if(F.col("status") == "published").alias("_p"))
    parents = books.select(F.col("id").alias("parent_book_id"), F.col("slug").alias("parent_slug"))
    out = books.join(counts, "id", "left").join(parents, "parent_book_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"actual_chapters": F.coalesce("_n", zero), "published_chapters": F.coalesce("_p", zero)}).drop("_n", "_p")


def drift(expected: DataFrame, actual: DataFrame, fields: list[str], tags: str | None = None) -> DataFrame:
    """(slug, message) for each way in which the actual state of a book differs from the expected."""
    one = lambda c: F.concat(F.lit(f"{c} mismatch"))
    differs = [F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), one(c)) for c in fields]
    if tags:
        differs.append(F.when(~text.tag_key(F.col(f"e.{tags}")).eqNullSafe(text.tag_key(F.col(f"a.{tags}"))), f"{tags} mismatch"))
    both = expected.alias("e").join(actual.alias("a"), F.col("e.slug") == F.col("a.slug"), "left")
    messages = F.when(F.col("a.slug").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(F.col("e.slug").alias("slug"), F.explode(messages).alias("message"))


def release_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(slug, message) of every check of a release that a published book fails.

    expected: slug, title, author, language, category, status, chapters, description_length, tags, cover_uploaded,
    translation_of_slug. actual: slug, title, author_name, language_code, category, status, total_chapters,
    actual_chapters, published_chapters, description, tags, cover_url, parent_slug.
    """
    e, a = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"a.{c}"))
    told = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    count = lambda c, name: (a(c), e("chapters"), F.concat(F.lit(f"{name} "), told(a(c)), F.lit(", expected "), told(e("chapters"))))
    none = F.array().cast("array<string>")
    cover = F.coalesce(a("cover_url"), F.lit(""))
    equal = [
        (a("title"), e("title"), "title mismatch"),
        (a("author_name"), e("author"), "author mismatch"),
        (a("language_code"), e("language"), "language mismatch"),
        (a("category"), e("category"), "category mismatch"),
        (a("status"), e("status"), F.concat(F.lit("status is "), told(a("status")), F.lit(", expected "), told(e("status")))),
        count("total_chapters", "total_chapters is"),
        count("actual_chapters", "chapter rows are"),
        count("published_chapters", "published chapter rows are"),
        (F.length(F.coalesce(a("description"), F.lit(""))), e("description_length"), "description mismatch"),
        (text.tag_key(F.coalesce(a("tags"), none)), text.tag_key(F.coalesce(e("tags"), none)), "tags mismatch"),
        (a("parent_slug"), e("translation_of_slug"), "translation pairing mismatch"),
    ]
    found = [F.when(~x.eqNullSafe(y), F.lit(m) if isinstance(m, str) else m) for x, y, m in equal]
    found.append(F.when(cover == "", "cover_url is missing"))
    found.append(F.when(F.coalesce(e("cover_uploaded"), F.lit(False)) & ~cover.rlike("[?&]v=\\d+"), "uploaded cover is not versioned"))
    both = expected.alias("e").join(actual.alias("a"), e("slug") == a("slug"), "left")
    messages = F.when(a("slug").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*found)))
    return both.select(e("slug").alias("slug"), F.explode(messages).alias("message"))


def asset_totals(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row: files, bytes, the largest file, how many are too large, and whether all limits hold."""
    total = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.max(F.struct("bytes", "path")).alias("_top"), F.count_if(F.col("bytes") > max_bytes).alias("oversized")
    )
    within = (F.col("files") <= max_files) & (F.col("oversized") == 0)
    return total.select("files", "bytes", F.col("_top.path").alias("largest_path"), F.col("_top.bytes").alias("largest_bytes"), "oversized", within.alias("within_limits"))


def count_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with their number of children, none being 0."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def to_transfer(source: DataFrame, present: DataFrame, key: str = "path", size: str = "bytes", tolerance: int = 10) -> DataFrame:
    """Files that are not present, or whose size differs by ``tolerance`` or more."""
    have = present.select(key, F.col(size).alias("_have"))
    return source.join(have, key, "left").where(F.col("_have").isNull() | (F.abs(F.col(size) - F.col("_have")) >= tolerance)).drop("_have")


def match_ids(slugs: DataFrame, ids: DataFrame) -> DataFrame:
    """(slug, book_id): the first of the ids ``<date>_<name>``, in their order, that ends with the slug, or whose name
    the slug contains with ``_`` for ``-``; null if none does. An id without a name is contained in every slug.

    Both conditions are equal keys first. A name meets a slug in its own suffixes, its first id for all that share it; ids meet
    a slug in longer suffixes only if what follows the slug's first ``_`` is their name. A name meets a slug in its
    first 2^k characters, the most that it has, which stand at some place of the slug; what met is then compared whole.
    No join is a broadcast one, as names and slugs are as many as the tables have.
    """
    rest = "^[^_]*_(.*)$"
    texts = slugs.select("slug").where(F.length("slug") > 0).distinct()
    named = ids.select("book_id").where("book_id is not null").withColumn("_name", F.regexp_extract("book_id", rest, 1))
    first = written(named.groupBy("_name").agg(F.min("book_id").alias("book_id")), "first-ids")
    with_name = first.where("_name <> ''")

    def ends(rows: DataFrame, whole: str, n: Column) -> DataFrame:
        """The suffixes of ``whole`` that begin at its first ``n`` characters."""
        return rows.select("book_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(whole, k))).alias("slug"))

    rests = texts.select(F.regexp_extract("slug", rest, 1).alias("_name")).where("_name <> ''").distinct()
    long = named.join(rests.hint("merge"), "_name", "left_semi")
    nameless = named.where("_name = '' and book_id <> ''")
    suffixes = ends(with_name, "_name", F.length("_name")).unionByName(ends(long, "book_id", F.length("book_id") - F.length("_name"))).unionByName(ends(nameless, "book_id", F.length("book_id")))
    by_end = suffixes.join(texts.hint("merge"), "slug").groupBy("slug").agg(F.min("book_id").alias("_id"))

    powers = F.array(*[F.lit(1 << k) for k in range(11)])
    starts = with_name.where(F.length("_name") <= 2047).withColumn("_q", F.array_max(F.filter(powers, lambda q: q <= F.length("_name"))))
    spelled = texts.withColumn("_spelled", F.replace("slug", F.lit("-"), F.lit("_")))
    places = F.transform(F.sequence(F.lit(1), F.length("_spelled")), lambda p: F.transform(F.filter(powers, lambda q: q <= F.length("_spelled") - p + 1), lambda q: F.struct(q.alias("_q"), F.col("_spelled").substr(p, q).alias("_gram"))))
    grams = spelled.select("slug", "_spelled", F.explode(F.array_distinct(F.flatten(places))).alias("_g")).select("slug", "_spelled", "_g.*")
    met = grams.join(starts.select("book_id", "_name", "_q", F.col("_name").substr(F.lit(1), F.col("_q")).alias("_gram")).hint("merge"), ["_q", "_gram"])
    by_name = met.where(F.contains("_spelled", "_name")).groupBy("slug").agg(F.min("book_id").alias("_id"))

    any_ = first.where("_name = ''").agg(F.min("book_id").alias("_any"))  # one row
    best = by_end.unionByName(by_name).groupBy("slug").agg(F.min("_id").alias("_id"))
    both = slugs.join(best.hint("merge"), "slug", "left").join(F.broadcast(any_))
    return both.select("slug", F.least("_id", F.when(F.length("slug") > 0, F.col("_any"))).alias("book_id"))


#: Fixed value: entries of a page of a folder's listing.
LISTING_PAGE = 200


def folder_pages(files: DataFrame, page: int = LISTING_PAGE) -> DataFrame:
    """(folder, name, is_folder, position, page) of every entry of every folder above ``files`` (path), folders first, then by name.

    Entries are ranked over all folders at once, so a folder of any size is in many tasks.
    """
    from .catalog import ranked

    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    entry = lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("folder"), F.element_at(parts, k).alias("name"), (k < F.size(parts)).alias("is_folder"))
    listed = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), entry)).alias("_e")).select("_e.*").distinct()
    placed = ranked(listed, F.col("folder"), F.desc("is_folder"), F.col("name"))
    first = placed.groupBy("folder").agg(F.min("rank").alias("_first"))
    position = F.col("rank") - F.col("_first")
    return placed.join(first, "folder").select("folder", "name", "is_folder", (position + 1).alias("position"), (F.floor(position / page) + 1).cast("long").alias("page"))


def _character_counts(texts: pd.Series) -> pd.Series:
    """Characters of UTF-8 texts with their numbers, in order, without white space; null stays."""

    def told(raw: bytes) -> str:
        counts = Counter(raw.decode("utf-8", "replace"))
        return "".join(f"{c}{n} " for c, n in sorted(counts.items()) if c not in text.JSWS_CHARACTERS)

    return texts.map(told, na_action="ignore").astype(object)


def same_characters(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """key and whether both texts have the same characters equally often, white space aside. Only their counts meet."""
    counts = F.pandas_udf(_character_counts, "string")
    signature = lambda rows, name: rows.select(key, counts(F.col(column).cast("binary")).alias(name))
    return signature(left, "_l").join(signature(right, "_r"), key, "full_outer").select(key, F.col("_l").eqNullSafe(F.col("_r")).alias("same"))


def stored_sizes(chapters: DataFrame) -> DataFrame:
    """By book the number and bytes of stored chapters (ciphertext and initial vector)."""
    return chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum(F.length("ciphertext") + F.length("iv")).alias("bytes"))


def log_steps(spark, path: str, rows: list[tuple[str, str, str]]) -> None:
    """Append (run, step, outcome) rows to a release log; earlier steps stay if a later one fails."""
    spark.createDataFrame(rows, "run string, step string, outcome string").coalesce(1).write.mode("append").json(path)


def offline_status(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, downloaded_count, is_available) of every book: stored chapters, and whether there is any."""
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return books.select("book_id").join(counts, "book_id", "left").select("book_id", n.alias("downloaded_count"), (n > 0).alias("is_available"))


def environment(text_rows: DataFrame, column: str = "line", order: str = "position") -> DataFrame:
    """(key, value) of ``KEY=VALUE`` lines; later lines win; comments, lines without a key and enclosing quotes are left out."""
    line = F.trim(F.col(column))
    parts = F.regexp_extract(line, "^(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)\\s*=", 1)
    value = F.trim(F.regexp_replace(line, "^[^=]*=", ""))
    rows = text_rows.where(~line.startswith("#") & (parts != "")).select(parts.alias("key"), value.alias("_value"), F.col(order).alias("_order"))
    last = rows.groupBy("key").agg(F.max_by("_value", "_order").alias("_value"))
    value = F.col("_value")
    bare = F.when(value.rlike("^\".*\"$|^'.*'$") & (F.length(value) > 1), F.expr("substr(_value, 2, length(_value) - 2)")).otherwise(value)
    return last.select("key", bare.alias("value"))


def response_rows(responses: DataFrame) -> DataFrame:
    """(slug, state, found): responses (slug, status, body, error) as rows of an audit; a failure is a row, not an end."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("status").between(200, 299), "ok").otherwise(F.concat(F.lit("http-"), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    listed = F.try_variant_get(F.try_parse_json("body"), "$.books", "array<variant>")
    return responses.select("slug", state.alias("state"), F.when(state == "ok", F.coalesce(F.size(listed), F.lit(0))).otherwise(0).alias("found"))


#: Attempts of a request, the first wait, the longest, and the longest that a server may ask for, in milliseconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, LONGEST_ASKED = 5, 500, 8000, 15_000


def retry_waits(attempts: DataFrame) -> DataFrame:
    """Attempts (attempt, status, retry_after_seconds) with wait_ms before the next one, null if there is none.

    Failures without a status, too many requests and server errors are tried again.
    """
    again = (F.col("attempt") < ATTEMPTS) & (F.col("status").isNull() | (F.col("status") == 429) | (F.col("status") >= 500))
    doubled = F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long")
    asked = F.when(F.col("retry_after_seconds").isNotNull(), F.least(F.lit(LONGEST_ASKED), F.col("retry_after_seconds") * 1000)).cast("long")
    return attempts.withColumn("wait_ms", F.when(again, F.coalesce(asked, doubled)))


def recorded(publishes: DataFrame, books: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log of publications with ``releases`` added, and the books with the outcome of their last one: to be published together.

    ``releases`` have book_id, result, remote_status, slug, error and finished_at. A release that is logged already
    is not logged again; one of a book that is not there is left out, as it would have no parent.
    """
    known = releases.join(books.select("book_id"), "book_id", "left_semi").select(publishes.columns)
    log = publishes.unionByName(known).distinct()
    last = known.groupBy("book_id").agg(F.max_by(F.struct("result", "slug", "finished_at", "error"), F.struct("finished_at", "result", "slug", "error")).alias("_last"))
    new = {"publish_state": "result", "published_slug": "slug", "published_at_remote": "finished_at", "last_error": "error"}
    both = books.join(last, "book_id", "left")
    updated = both.withColumns({column: F.when(F.col("_last").isNotNull(), F.col(f"_last.{field}")).otherwise(F.col(column)) for column, field in new.items()})
    return log, updated.select(books.columns)
