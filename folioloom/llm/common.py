"""What the operators of this subpackage share: shared-folder tables and Arrow access."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.sources import shared
from folioloom.sources.shared import root

__all__ = ["column", "crc_bucket", "guarded", "materialise", "partitions", "ragged", "root", "ship", "slices", "text_bytes"]


_MADE: list[str] = []
#: Bytes of an Arrow batch on its way to Python; a row may have more.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound Arrow batches by bytes unless the session does."""
    shared.ship(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came before,
    and identifiers made in ``df`` stay as they were written.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables were written so far and not dropped."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete the tables written after ``made`` was ``mark``, but for the last ``keep``: what they led to is written."""
    gone = _MADE[mark : len(_MADE) - keep]
    del _MADE[mark : len(_MADE) - keep]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def guarded(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with names that no operator uses, these names, and what gives a result the old names back.

    ``kept`` columns (the text, above all) stay as they are called; so further columns may be called as they like.
    """
    names = [c if c in kept else f"_in{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names, lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def text_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow column as bytes, nulls as empty."""
    if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [value or b"" for value in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
