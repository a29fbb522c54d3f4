"""Readers of the engine's file inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manuscripts(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text) of every file below ``path``, a leading byte order mark taken off."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\uFEFF", "").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of every file below ``path`` that is not empty; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def covers(spark: SparkSession, path: str) -> DataFrame:
    """(path, data_url) of image files."""
    kinds = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.lower(F.regexp_extract("path", "\\.(\\w+)$", 1))]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.where(kind.isNotNull()).select("path", F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content")).alias("data_url"))


def documents(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON documents of a known schema; without ``strict`` a broken one gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def first_available(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first readable of several tables, an empty one if there is none: snapshot, then source."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def checked_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; raises if a key repeats."""
    again = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} repeats")
    return rows


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; partition options go to Spark's reader."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
