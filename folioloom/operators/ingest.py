"""Validated bulk ingestion on table snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import text

MAX_BOOKS, MAX_CHAPTERS, MAX_BATCH_CHAPTERS, MAX_TAGS, MAX_TAG_LENGTH = 20, 800, 1000, 12, 40
CLASSIC_TAG, LONG_CHAPTER, SHORT_CHAPTER = "english classics", 50_000, 100
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def first_error(rules: list[tuple[Column, str | Column]]) -> Column:
    """The message of the first rule whose condition holds, null if none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message) if isinstance(message, str) else message) for bad, message in rules], F.lit(None))


def blank(c: Column) -> Column:
    return text.js_trim(F.coalesce(c, F.lit(""))) == ""


def book_errors(books: DataFrame, chapters_only: bool = False) -> DataFrame:
    """``books`` with the first rule that each breaks, as ``error``.

    Columns: slug, title, author, language, category, description, cover_url, tags, status,
    translation_of_slug, chapters (array of number, title, content).
    """
    chapters = F.coalesce("chapters", F.array().cast("array<struct<number:int,title:string,content:string>>"))
    numbers = F.transform(chapters, lambda c: c["number"])
    published = F.lit(not chapters_only) & (F.col("status") == "published")
    tags = text.normalize_tags(F.coalesce("tags", F.array().cast("array<string>")))
    cover = F.coalesce("cover_url", F.lit(""))
    bad_chapter = F.exists(chapters, lambda c: F.coalesce(c["number"] < 1, F.lit(True)) | blank(c["title"]) | blank(c["content"]))
    return books.withColumn(
        "error",
        first_error(
            [
                (blank(F.col("title")) | blank(F.col("author")) | blank(F.col("slug")) | ~F.coalesce(F.col("language").isin("en", "sw"), F.lit(False)), "needs title, author and language"),
                (~F.col("slug").rlike(SLUG), "invalid slug"),
                (F.lit(not chapters_only) & (cover != "") & ~cover.rlike("(?i)^https://") & ~cover.startswith("/covers/"), "invalid cover address"),
                (published & (cover == ""), "needs a cover"),
                (published & blank(F.col("description")), "needs a description"),
                ((F.size(chapters) < 1) | (F.size(chapters) > MAX_CHAPTERS), "needs between 1 and 800 chapters"),
                (bad_chapter | (F.size(F.array_distinct(numbers)) < F.size(numbers)), "chapter without title or content, or repeated number"),
                (published & ~F.coalesce(F.col("category").isin(*text.CATEGORIES), F.lit(False)), "needs a canonical category"),
                (published & (F.size(tags) == 0), "needs a tag"),
                ((F.size(tags) > MAX_TAGS) | F.exists(tags, lambda t: F.length(t) > MAX_TAG_LENGTH), "too many or too long tags"),
                (F.col("translation_of_slug") == F.col("slug"), "translation of itself"),
            ]
        ),
    )


def batch_errors(books: DataFrame) -> DataFrame:
    """One row: number of books and chapters, repeated slugs, and whether the batch may go in."""
    each = books.select("slug", F.coalesce(F.size("chapters"), F.lit(0)).alias("n"))
    slugs = each.groupBy("slug").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    total = slugs.agg(F.sum("k").alias("books"), F.sum("n").alias("chapters"), F.count_if(F.col("k") > 1).alias("repeated_slugs"))
    fits = (F.col("books").between(1, MAX_BOOKS)) & (F.col("chapters") <= MAX_BATCH_CHAPTERS) & (F.col("repeated_slugs") == 0)
    return total.withColumn("accepted", F.coalesce(fits, F.lit(False)))


#: Fixed patterns: titles and bodies that look like contents or page lists.
_NAVIGATION = "^(?:contents?|table of contents|index|navigation)$"
_MARKER = "(?i)^(?:chapter\\s+)?(?:\\d+|[ivxlcdm]+|[-–—\\s]+(?:\\d+|[ivxlcdm]+)[-–—\\s]*)$"
_PAGES = "(?i)^(?:(?:\\[\\s*(?:\\d+|[ivxlcdm]+)\\s*\\]\\s*)+|(?:(?:page\\s*)?(?:\\d+|[ivxlcdm]+)[,;|\\s]*)+)$"


def suspiciously_short(title: Column, content: Column) -> Column:
    """A short chapter that seems to be a table of contents or page navigation."""
    name = F.regexp_replace(F.lower(text.js_trim(title)), "[.:]+$", "")
    return (text.word_count(content) < SHORT_CHAPTER) & (name.rlike(_NAVIGATION) | (name.rlike(_MARKER) & text.collapse(content).rlike(_PAGES)))


def integrity_errors(books: DataFrame, precomputed: bool = False) -> DataFrame:
    """The gate for classics: ``books`` (tags, integrity struct, chapters) with ``error``.

    Without ``precomputed`` word counts and suspicious chapters are counted anew from the texts.
    """
    classic = F.exists("tags", lambda t: F.lower(text.js_trim(t)) == CLASSIC_TAG)
    told = [F.col("integrity").alias("integrity")]
    if not precomputed:
        counts = F.transform("chapters", lambda c: text.word_count(c["content"]))
        odd = F.size(F.filter("chapters", lambda c: suspiciously_short(c["title"], c["content"]))).cast("long")
        told += [counts.alias("counts"), odd.alias("odd")]
    # texts are counted once, however many rules ask
    return books.withColumn("error", F.when(classic, text.bound(F.struct(*told), lambda s: first_error(_integrity_rules(s, precomputed)))))


def _integrity_rules(told: Column, precomputed: bool) -> list[tuple[Column, str]]:
    i = lambda name: told["integrity"][name]
    sha = "^[a-f0-9]{64}$"
    source, rebuilt = F.lower(i("source_sha")), F.lower(i("rebuilt_sha"))
    negative = lambda name: F.coalesce(i(name) < 0, F.lit(True))
    rules = [
        (told["integrity"].isNull(), "must include integrity metadata"),
        (~F.coalesce(i("verified"), F.lit(False)), "must have verified integrity metadata"),
        (~F.coalesce(source.rlike(sha) & rebuilt.rlike(sha) & (source == rebuilt), F.lit(False)), "failed its preservation check"),
        (~F.coalesce((i("source_words") > 0) & (i("rebuilt_words") > 0), F.lit(False)), "must include positive word counts"),
        (~F.coalesce((i("source_words") == i("rebuilt_words")) & (i("coverage") == 1), F.lit(False)), "must preserve all source words"),
    ]
    if precomputed:
        return rules + [
            (negative("min_words"), "has invalid least words"),
            (negative("max_words"), "has invalid most words"),
            (i("max_words") > LONG_CHAPTER, "contains a too long chapter"),
            (negative("suspicious"), "has an invalid suspicious count"),
            (i("suspicious") != 0, "contains a suspicious chapter"),
        ]
    counts, odd = told["counts"], told["odd"]
    prints = [F.coalesce(i(n), F.lit("")) for n in ("source_start", "source_end", "rebuilt_start", "rebuilt_end")]
    return rules + [
        (i("rebuilt_words") != F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b), "does not match the chapters' words"),
        ((i("min_words") != F.array_min(counts)) | (i("max_words") != F.array_max(counts)), "does not match the chapters' extremes"),
        (i("suspicious") != odd, "does not match the suspicious chapters"),
        (odd != 0, "contains a suspicious chapter"),
        (F.array_max(counts) > LONG_CHAPTER, "contains a too long chapter"),
        ((prints[0] == "") | (prints[1] == "") | (prints[0] != prints[2]) | (prints[1] != prints[3]), "failed its start and end check"),
    ]


def missing_metadata(title: Column, author: Column, description: Column, cover: Column, language: Column) -> Column:
    """Names of the fields without which a book cannot be published."""
    parts = [(blank(title), "title"), (blank(author), "author"), (blank(description), "description"), (blank(cover), "cover"), (~F.coalesce(language.isin("en", "sw"), F.lit(False)), "language (en or sw)")]
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in parts]))


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by ``order`` (a total order): maxima meet, no key is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after ``source`` (one row a key) replaces or joins the rows of ``target``."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def merge_columns(target: DataFrame, source: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """As upsert, but known rows keep their own values of ``kept``."""
    both = target.alias("t").join(source.alias("s"), keys, "full_outer")
    known = F.col("t." + keys[0]).isNotNull()
    value = lambda c: F.when(known & (F.lit(c in kept) | F.col(f"s.{keys[0]}").isNull()), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(*[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in target.columns if c not in keys])


def stale_children(present: DataFrame, sent: DataFrame, parent: str, number: str) -> DataFrame:
    """Rows of sent parents whose number was not sent."""
    of_sent = present.join(sent.select(parent).distinct(), parent, "left_semi")
    return of_sent.join(sent.select(parent, number), [parent, number], "left_anti")


def delete_by_key(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and the wanted keys that are not there."""
    return rows.join(wanted.select(key), key, "left_anti"), wanted.select(key).distinct().join(rows.select(key), key, "left_anti")


def versions(history: DataFrame, key: list[str], order: list[str], content: str) -> DataFrame:
    """``history`` with content_version, which grows when the content differs from that before."""
    window = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(window) == 1
    changed = F.when(first, 1).otherwise((~F.col(content).eqNullSafe(F.lag(content).over(window))).cast("int"))
    return history.withColumn("_changed", changed).withColumn("content_version", F.sum("_changed").over(window)).drop("_changed")


def parent_errors(books: DataFrame) -> DataFrame:
    """Books that name a parent, with the rule that the pair breaks."""
    parents = books.select(F.col("id").alias("_id"), F.col("parent_book_id").alias("_grand"), F.col("language_code").alias("_language"))
    rule = first_error(
        [
            (F.col("parent_book_id") == F.col("id"), "own parent"),
            (F.col("_id").isNull(), "no such parent"),
            (F.col("_grand").isNotNull(), "parent is a translation"),
            (F.col("_language") == F.col("language_code"), "same language"),
        ]
    )
    return books.where("parent_book_id is not null").join(parents, F.col("parent_book_id") == F.col("_id"), "left").select("id", "parent_book_id", rule.alias("error"))


def batch_parents(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """``batch`` (slug, language, translation_of_slug) with parent_id, parent_in_batch and ``error``.

    An original is looked for in the batch first, then among ``existing`` books (id, slug, language_code).
    """
    inside = batch.select(F.col("slug").alias("_slug"), F.col("language").alias("_here"), F.nullif(F.col("translation_of_slug"), F.lit("")).alias("_of"), F.lit(True).alias("_in"))
    outside = existing.select(F.col("slug").alias("_known"), F.col("id").alias("_id"), F.col("language_code").alias("_there"))
    wanted = F.nullif(F.col("translation_of_slug"), F.lit(""))
    both = batch.join(inside, wanted == F.col("_slug"), "left").join(outside, wanted == F.col("_known"), "left")
    within = F.coalesce("_in", F.lit(False))
    error = first_error(
        [
            (wanted.isNotNull() & ~within & F.col("_known").isNull(), "no such original"),
            (within & F.col("_of").isNotNull(), "original is a translation"),
            (wanted.isNotNull() & (F.coalesce("_here", "_there") == F.col("language")), "same language as its original"),
        ]
    )
    return both.select(*batch.columns, F.when(wanted.isNotNull(), F.col("_id")).alias("parent_id"), within.alias("parent_in_batch"), error.alias("error"))


def paired_groups(files: DataFrame) -> DataFrame:
    """Editions (folder, slug, language, translation_of_slug) with the original of their group and ``error``.

    The root of a group is its first English edition, else its first; another edition translates the root unless it names
    an original itself. A group may have one edition of a language.
    """
    first = F.min(F.struct((F.col("language") != "en").alias("_later"), "slug", "language"))
    groups = files.groupBy("folder").agg(first.alias("_root"), F.count("*").alias("_n"), F.countDistinct("language").alias("_languages"))
    root = F.col("_root.slug")
    own = F.nullif(F.col("translation_of_slug"), F.lit(""))
    of = F.when(F.col("slug") == root, own).otherwise(F.coalesce(own, root))
    error = F.when(F.col("_n") != F.col("_languages"), "two editions of one language")
    return files.join(groups, "folder").select("folder", "slug", "language", root.alias("root_slug"), of.alias("translation_of_slug"), error.alias("error"))


def chapters_only_errors(batch: DataFrame, existing: DataFrame, precomputed: bool = False) -> DataFrame:
    """Updates of chapters alone (slug, title, integrity, chapters) with ``error``.

    Only existing books (slug, title, tags) can be updated; their own title and tags decide whether the gate for
    classics applies, not those that were sent.
    """
    known = existing.select("slug", F.col("title").alias("_title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit(True).alias("_known"))
    both = batch.drop("tags").join(known, "slug", "left").withColumns({"title": F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("title")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    checked = integrity_errors(both, precomputed)
    return checked.withColumn("error", F.when(F.col("_known").isNull(), "no such book").otherwise(F.col("error"))).drop("_title", "_known")


def single_import_errors(books: DataFrame) -> DataFrame:
    """One-book imports (book_id, title, author, language, chapters) with the first rule that each breaks."""
    chapters = F.coalesce("chapters", F.array().cast("array<struct<number:bigint,title:string,content:string>>"))
    numbers = F.transform(chapters, lambda c: c["number"])
    whole = F.forall(chapters, lambda c: F.coalesce((c["number"] >= 1) & (c["number"] <= (1 << 53) - 1), F.lit(False)) & ~blank(c["title"]) & ~blank(c["content"]))
    unnamed = F.col("book_id").isNull() & (blank(F.col("title")) | blank(F.col("author")) | blank(F.col("language")))
    return books.withColumn(
        "error",
        first_error(
            [
                (~F.size(chapters).between(1, 100), "provide between 1 and 100 chapters"),
                (~whole | (F.size(F.array_distinct(numbers)) != F.size(numbers)), "every chapter needs its own positive number, a title and content"),
                (unnamed, "title, author and language are required"),
            ]
        ),
    )


def publication(books: DataFrame, chapters: DataFrame, batch: DataFrame, sent: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots of an import: books while it runs, chapters, and books after it.

    ``batch`` has the columns of ``books`` (id, status, published_at, total_chapters among them), ``sent`` those of
    ``chapters``. While chapters change the books are drafts; chapters are replaced by number, the others of a
    sent book go; then each book gets its status, its time of publication and its number of chapters.
    """
    time = F.lit(now).cast("timestamp")
    counts = sent.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("_n"))
    counted = batch.join(counts, "id", "left").withColumn("total_chapters", F.coalesce("_n", F.lit(0)).cast(books.schema["total_chapters"].dataType)).drop("_n")
    draft = counted.withColumns({"status": F.lit("draft"), "published_at": F.lit(None).cast("timestamp")})
    final = counted.withColumn("published_at", F.when(F.col("status") == "published", time))
    timed = sent.withColumn("published_at", F.when(F.col("status") == "published", time))
    kept = chapters.join(batch.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return upsert(books, draft, ["id"]), kept.unionByName(timed.select(*chapters.columns)), upsert(books, final, ["id"])


#: What must be said to delete everything, and (fixed) the most slugs that may be named.
DELETE_ALL, MOST_DELETED = "DELETE ALL BOOKS", 50


def guarded_delete(books: DataFrame, slugs: list[str], confirmation: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books that stay, slugs that go, and wanted slugs that are not there. All go only with the exact confirmation."""
    if confirmation == DELETE_ALL:
        return books.limit(0), books.select("slug"), books.select("slug").limit(0)
    wanted = sorted({t for s in slugs if re.fullmatch(SLUG, t := s.strip())})
    if not 1 <= len(wanted) <= MOST_DELETED:
        raise ValueError(f"provide between 1 and {MOST_DELETED} slugs")
    asked = books.sparkSession.createDataFrame([(s,) for s in wanted], "slug string")
    stay, missing = delete_by_key(books, asked, "slug")
    return stay, books.where(F.col("slug").isin(*wanted)).select("slug"), missing


def linked_translations(books: DataFrame) -> DataFrame:
    """``books`` in which a Kiswahili edition without a parent has the English one whose slug is its own without ``-sw``."""
    originals = books.where((F.col("language_code") == "en") & F.col("parent_book_id").isNull()).select(F.col("id").alias("_original"), F.concat("slug", F.lit("-sw")).alias("_twin"))
    lone = (F.col("language_code") == "sw") & F.col("parent_book_id").isNull()
    both = books.join(originals, lone & (F.col("slug") == F.col("_twin")), "left")
    return both.withColumn("parent_book_id", F.coalesce("parent_book_id", "_original")).select(*books.columns)


def without_parents(rows: DataFrame, gone: DataFrame, reference: str, rule: str) -> DataFrame:
    """``rows`` after the rows with the ids of ``gone`` went: ``cascade`` drops those that refer to them, ``set null`` keeps them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    if rule == "cascade":
        return rows.join(ids, F.col(reference) == F.col("_gone"), "left_anti")
    met = rows.join(ids, F.col(reference) == F.col("_gone"), "left")
    return met.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*rows.columns)


def touched(before: DataFrame, after: DataFrame, key: str, now: str, column: str = "updated_at") -> DataFrame:
    """``after`` with ``column`` set to ``now`` in every row that was there before and was sent again, whatever was sent in it."""
    known = before.select(key, F.lit(True).alias("_known"))
    stamp = F.when(F.col("_known"), F.lit(now).cast(after.schema[column].dataType)).otherwise(F.col(column))
    return after.join(known, key, "left").withColumn(column, stamp).select(*after.columns)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def local_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters of a local book that can be shown: a safe positive whole number, and content that is a text."""
    number = F.col("number").cast("double")
    return chapters.where((number >= 1) & (number <= float((1 << 53) - 1)) & (number == F.floor(number)) & F.col("content").isNotNull())


def batch_totals(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: books, chapters, how many books are new and how many are updated."""
    known = existing.select("slug", F.lit(True).alias("_known")).dropDuplicates(["slug"])
    both = batch.join(known, "slug", "left")
    return both.agg(F.count("*").alias("books"), F.coalesce(F.sum(F.size("chapters")), F.lit(0)).cast("long").alias("chapters"), F.count_if(F.col("_known").isNull()).alias("creates"), F.count_if(F.col("_known").isNotNull()).alias("updates"))


def changes(source: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """key and create, update, unchanged or removed."""
    both = source.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in")).join(target.select(key, F.col(content).alias("_old"), F.lit(True).alias("_was")), key, "full_outer")
    action = F.when(F.col("_was").isNull(), "create").when(F.col("_in").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("update")
    return both.select(key, action.alias("action"))


def all_or_nothing(checked: DataFrame) -> DataFrame:
    """The rows if none has an error, else none. One failed row is looked for; no row is brought to the driver."""
    failed = checked.where("error is not null").select(F.lit(True).alias("_failed")).limit(1)
    return checked.join(F.broadcast(failed), F.col("_failed"), "left_anti").drop("error")


#: Columns that an editor may change.
PERMITTED = ("title", "author_name", "language_code", "category", "description", "cover_url", "status", "is_featured", "published_at")


def permitted(changes: Column) -> Column:
    """Of a map of changes the entries that an editor may make."""
    return F.map_filter(changes, lambda k, v: k.isin(*PERMITTED))


def patch(books: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """``books`` after ``patches`` (id, changes as a map of strings), with ``error``.

    Only permitted columns change. A book may become published only with a cover and a description,
    counting the change, and is then published ``now`` if no time is given; else it stays as it was.
    """
    both = books.join(patches.select("id", permitted(F.col("changes")).alias("_p")), "id", "left")
    value = lambda c: F.coalesce(F.try_element_at("_p", F.lit(c)).cast(books.schema[c].dataType), F.col(c))
    publishing = F.coalesce(F.try_element_at("_p", F.lit("status")) == "published", F.lit(False))
    error = first_error([(publishing & blank(value("cover_url")), "add a cover before publishing"), (publishing & blank(value("description")), "add a description before publishing")])
    new = {c: value(c) for c in PERMITTED if c in books.columns}
    if "published_at" in new:
        given = F.try_element_at("_p", F.lit("published_at")).cast(books.schema["published_at"].dataType)
        new["published_at"] = F.when(publishing, F.coalesce(given, F.lit(now).cast(books.schema["published_at"].dataType))).otherwise(new["published_at"])
    checked = both.withColumn("error", error)
    return checked.select(*[F.when(F.col("error").isNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in books.columns], "error")


def classify(title: Column, sets: dict[str, list[str]], fallback: str, tags: list[tuple[str, str]] = ()) -> Column:
    """struct(category, tags): the first set that holds the title, and the tags whose pattern it has."""
    category = F.lit(fallback)
    for name, titles in reversed(sets.items()):
        category = F.when(title.isin(*titles), name).otherwise(category)
    found = F.array_compact(F.array(*[F.when(title.rlike(pattern), tag) for tag, pattern in tags])) if tags else F.array().cast("array<string>")
    return F.struct(category.alias("category"), found.alias("tags"))


def first_publication(books: DataFrame, years: DataFrame, key: str = "title") -> DataFrame:
    """Books with ``label``: the year in which they first came out, out of a table (key, year), or that it is unknown."""
    known = years.select(key, F.col("year").alias("_year")).dropDuplicates([key])
    label = F.coalesce(F.concat(F.lit("First published "), F.col("_year").cast("string")), F.lit("Publication year unknown"))
    return books.join(known, key, "left").withColumn("label", label).drop("_year")
