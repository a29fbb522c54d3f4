"""Catalogue queries: visibility, works and editions, ranking, windows and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.sources.shared import written

CLASSIC = "(?i)\\bclassics?\\b"


def shown(now: str) -> Column:
    """Published, and not later than ``now``."""
    return (F.col("status") == "published") & (F.col("published_at").isNull() | (F.col("published_at") <= F.lit(now).cast("timestamp")))


def visible_books(books: DataFrame, now: str, language: str | None = None, role: str = "reader") -> DataFrame:
    """Books that a role may see; editors and administrators see all."""
    out = books if role in ("editor", "admin") else books.where(shown(now))
    return out if language is None else out.where(F.col("language_code") == language)


def visible_chapters(chapters: DataFrame, books: DataFrame, now: str) -> DataFrame:
    """Visible chapters of visible books."""
    return chapters.where(shown(now)).join(books.where(shown(now)).select(F.col("id").alias("book_id")), "book_id", "left_semi")


def without_chapters(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Published books that have no published chapter."""
    has = chapters.where("status = 'published'").select(F.col("book_id").alias("id"))
    return books.where("status = 'published'").join(has, "id", "left_anti")


def root() -> Column:
    """A work's identity: the parent edition, else the book itself."""
    return F.coalesce("parent_book_id", "id")


def works(books: DataFrame) -> DataFrame:
    return books.groupBy(root().alias("root_id")).agg(F.count("*").alias("editions"), F.countDistinct("language_code").alias("languages"), F.min("id").alias("first_id"))


def ranked(books: DataFrame, *order: Column) -> DataFrame:
    """Books with their place in a total order, 1 first.

    Sorted partitions are counted and numbered with the counts of those before, so that no
    single task holds the catalogue.
    """
    spark = books.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = books.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = written(parts, "ranked")  # a second run could draw the ranges elsewhere
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # as many rows as partitions
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + inside + 1).cast("long")).drop("_part", "_at", "_before")


def status_label(books: DataFrame) -> DataFrame:
    """Completed by tag, else Bilingual if another edition exists, else Hot if featured, else Free."""
    parents = books.where("parent_book_id is not null").select(F.col("parent_book_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    paired = F.col("parent_book_id").isNotNull() | F.col("_has").isNotNull()
    label = (
        F.when(F.exists("tags", lambda t: F.lower(t) == "completed"), "Completed").when(paired, "Bilingual").when(F.col("is_featured"), "Hot").otherwise("Free")
    )
    heat = F.when(F.col("is_featured"), "Featured").otherwise(F.concat(F.col("total_chapters").cast("string"), F.lit(" chapters")))
    return books.join(parents, "id", "left").withColumns({"label": label, "heat": heat, "is_bilingual": paired}).drop("_has")


def localized(books: DataFrame, language: str) -> DataFrame:
    """For each work with an edition in ``language``: that edition, both titles, and the work's best rank."""
    pick = lambda value, code: F.min(F.when(F.col("language_code") == code, F.struct("rank", value)))[value]
    each = books.groupBy(root().alias("root_id")).agg(
        pick("title", "en").alias("title_en"), pick("title", "sw").alias("title_sw"), pick("id", language).alias("id"), F.min("rank").alias("rank"), F.countDistinct("language_code").alias("languages")
    )
    own = books.select("id", F.col("title").alias("_own"), "slug")
    return (
        each.where("id is not null")
        .join(own, "id")
        .select("root_id", "id", "slug", F.coalesce("title_en", "_own").alias("title"), F.col("title_sw").alias("title_swahili"), "rank", (F.col("languages") > 1).alias("is_bilingual"))
    )


def accent() -> Column:
    category = F.lower("category")
    return F.when(category == "romance", "orange").when(category == "thriller", "purple").when(F.col("language_code") == "sw", "teal").otherwise("green")


def age_label(at: Column, now: str) -> Column:
    """Just now, hours, Yesterday or days, by rounded hours."""
    hours = F.greatest(F.lit(0), F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)) / 3600 + 0.5)).cast("long")
    days = F.floor(hours / 24 + 0.5).cast("long")
    return (
        F.when(hours < 1, "Just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(hours < 48, "Yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits groups before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def chapter_window(chapters: DataFrame, start: int, count: int) -> DataFrame:
    """Of each book up to ``count`` (1 to 20) chapters from ``start`` on."""
    n = max(1, min(20, count))
    return top_of_each(chapters.where(F.col("chapter_number") >= max(1, start)), ["book_id"], [F.col("chapter_number")], n)


def neighbours(rows: DataFrame, key: str, number: str) -> DataFrame:
    window = Window.partitionBy(key).orderBy(number)
    return rows.select(key, number, F.lag(number).over(window).alias("previous"), F.lead(number).over(window).alias("next"))


def contiguity(rows: DataFrame, key: str, number: str, first: int = 1) -> DataFrame:
    """By key whether the numbers are ``first``, ``first`` + 1, ... without gap or repeat."""
    # dealt into a set number of parts: the counts of one task grow with its rows, and small shuffled rows would be put together
    rows = rows.select(key, number).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    good = (F.min(number) == first) & (F.max(number) == F.count("*") + first - 1) & (F.countDistinct(number) == F.count("*"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(good, F.lit(False)).alias("contiguous"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of the columns, without regard to case; all for a blank text."""
    wanted = text.strip().lower()
    if not wanted:
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted)) for c in columns]))


def search_joined(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in the columns joined by spaces."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))


def tab(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a tab of the catalogue; all rows for a name that is none."""
    rule = {
        "Romance": F.col("category") == "Romance",
        "Thriller": F.col("category") == "Thriller",
        "Free Zone": F.col("label").isin("Free", "Hot", "Bilingual"),
        "Completed": F.col("label") == "Completed",
        "Bilingual": F.col("is_bilingual"),
    }.get(name)
    return rows if rule is None else rows.where(rule)


def is_classic() -> Column:
    return F.coalesce(F.col("category").rlike(CLASSIC), F.lit(False)) | F.coalesce(F.exists("tags", lambda t: t.rlike(CLASSIC)), F.lit(False))


def hero(rows: DataFrame, *order: Column) -> DataFrame:
    """The first featured English book with a cover that is no classic, else the first such book; ``order`` is the catalogue's."""
    fit = (F.col("language_code") == "en") & ~is_classic() & (F.coalesce("cover_url", F.lit("")) != "")
    return rows.where(fit).orderBy(F.coalesce("is_featured", F.lit(False)).desc(), *(order or [F.col("id")])).limit(1)


def editors_choice(rows: DataFrame, flag: str, *order: Column) -> DataFrame:
    """The first book that is flagged, else the first."""
    return rows.orderBy(F.coalesce(flag, F.lit(False)).desc(), *(order or [F.col("id")])).limit(1)


def search_state(rows: DataFrame, text: str, columns: list[str], category: str) -> DataFrame:
    """One row: matches of a search, those of them in a category (all for 'All'), and whether it matched elsewhere only."""
    found = search_joined(rows, text, columns)
    here = F.lit(True) if category == "All" else F.col("category") == category
    counts = found.agg(F.count("*").alias("matches"), F.count_if(here).alias("shown"))
    return counts.withColumn("only_elsewhere", F.lit(text.strip() != "") & (F.col("matches") > 0) & (F.col("shown") == 0))


def owned(rows: DataFrame, user: str | None, role: str = "reader", owner: str = "user_id") -> DataFrame:
    """Rows that a user may see of a table in which each row belongs to one; administrators see all."""
    if role == "admin":
        return rows
    return rows.where(F.col(owner) == F.lit(user)) if user is not None else rows.limit(0)


def new_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profiles`` (id, display_name, role) with a reader's profile for each user (id, full_name, email) that has none."""
    name = F.coalesce("full_name", "email")
    return profiles.select("id", "display_name", "role").unionByName(users.join(profiles.select("id"), "id", "left_anti").select("id", name.alias("display_name"), F.lit("reader").alias("role")))


def shelf(entries: DataFrame, books: DataFrame) -> DataFrame:
    return entries.join(books, F.col("book_id") == books["id"]).drop("book_id")


def parallel_chapters(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters beside those of the same number in the work's editions of another language."""
    own = chapters.join(books.select(F.col("id").alias("book_id"), root().alias("root_id"), "language_code"), "book_id").select("root_id", "language_code", "book_id", "chapter_number")
    other = own.select("root_id", F.col("language_code").alias("other_language"), F.col("book_id").alias("other_book_id"), "chapter_number")
    return own.join(other, ["root_id", "chapter_number"]).where("language_code <> other_language")
