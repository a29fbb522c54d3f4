"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Bytes of an Arrow batch on its way to Python; a row may have more.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="folioloom-tables-"))
        base = "file://" + _LOCAL[0]
    folder = f"{base.rstrip('/')}/folioloom-core-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once and read back, so that what is not deterministic in it stays as it is."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application, and bound Arrow batches by bytes
    unless the session does."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_folioloom_shipped", None) == context.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="folioloom-"), "folioloom_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(where, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._folioloom_shipped = context.applicationId
