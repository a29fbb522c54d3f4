"""The engine's entities, derived from the test tables, in Spark and in SQL.

reading events come from ``events``, books from ``orders``, chapters from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of the queries.
EVENT_NOW = "2024-01-31 00:00:00"
BOOK_NOW = "2000-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file dealt out to all tasks, before work that costs much a row: a file's row group is one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def reading_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "book_view", "click", "chapter_start", "purchase", "chapter_complete", "signup", "bookshelf_add", "error", "offline_download")])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_id") % 97 == 0, "").otherwise(F.concat(F.lit("anon-"), F.col("user_id").cast("string"))).alias("anonymous_id"),
        F.coalesce(kind[F.col("event_type")], F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("user_id") * 7 % 200).alias("book_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("chapter_number"),
        "value",
        "props",
    )


READINGS = """readings AS (
  SELECT event_id, ts AS created_at,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE 'anon-' || user_id END AS anonymous_id,
         CASE event_type WHEN 'view' THEN 'book_view' WHEN 'click' THEN 'chapter_start' WHEN 'purchase' THEN 'chapter_complete'
              WHEN 'signup' THEN 'bookshelf_add' WHEN 'error' THEN 'offline_download' ELSE event_type END AS event_type,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id * 7 % 200 END AS book_id,
         CAST(event_id % 4 + 1 AS INTEGER) AS chapter_number, value, props
  FROM events
)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("o_orderkey") % 2 == 1
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("hidden")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("book-"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string"), F.when(odd, "-sw").otherwise("")).alias("slug"),
        F.concat(F.lit("Book "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Author "), F.col("o_custkey").cast("string")).alias("author_name"),
        F.when(odd, "sw").otherwise("en").alias("language_code"),
        F.when(odd & (F.col("o_orderkey") % 5 != 0), F.col("o_orderkey") - 1).alias("parent_book_id"),
        F.col("o_orderpriority").alias("category"),
        status.alias("status"),
        (F.col("o_totalprice") > 200000).alias("is_featured"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderdate").cast("timestamp")).alias("published_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        (F.col("o_custkey") % 9).cast("long").alias("total_chapters"),
        F.col("o_totalprice").alias("price"),
    )


BOOKS = """books AS (
  SELECT o_orderkey AS id, 'book-' || (o_orderkey - o_orderkey % 2) || CASE WHEN o_orderkey % 2 = 1 THEN '-sw' ELSE '' END AS slug,
         'Book ' || o_orderkey AS title, 'Author ' || o_custkey AS author_name,
         CASE WHEN o_orderkey % 2 = 1 THEN 'sw' ELSE 'en' END AS language_code,
         CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN o_orderkey - 1 END AS parent_book_id,
         o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'hidden' END AS status,
         o_totalprice > 200000 AS is_featured,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS published_at,
         o_orderdate AS updated_at, CAST(o_custkey % 9 AS BIGINT) AS total_chapters, o_totalprice AS price
  FROM orders
)"""


def chapter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as they were sent, with repeats of (book_id, chapter_number)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"),
        F.col("l_linenumber").alias("chapter_number"),
        F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string")).alias("title"),
        F.col("l_quantity").cast("long").alias("word_count"),
        F.when(F.col("l_linestatus") == "F", "published").otherwise("draft").alias("status"),
        F.when(F.col("l_partkey") % 6 == 0, None).otherwise(F.col("l_shipdate").cast("timestamp")).alias("published_at"),
        F.col("l_shipdate").cast("timestamp").alias("sent_at"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


CHAPTER_ROWS = """chapter_rows AS (
  SELECT l_orderkey AS book_id, l_linenumber AS chapter_number, 'Chapter ' || l_linenumber AS title, CAST(l_quantity AS BIGINT) AS word_count,
         CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'draft' END AS status,
         CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_shipdate END AS published_at,
         l_shipdate AS sent_at, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
)"""

#: The order in which repeated chapters were sent, last first.
SENT_ORDER = ("sent_at", "l_partkey", "l_suppkey", "l_extendedprice")

CHAPTERS = (
    CHAPTER_ROWS
    + """, chapters AS (
  SELECT book_id, chapter_number, title, word_count, status, published_at FROM chapter_rows
  QUALIFY row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY sent_at DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
)"""
)
