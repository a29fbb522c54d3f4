"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(name: str = "folioloom", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` are further ones."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
