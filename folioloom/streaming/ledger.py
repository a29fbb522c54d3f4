"""Work on a stream of pieces that may stop anywhere and go on: a ledger of what is finished.

Every batch leaves out the pieces that the ledger has as finished, works on the rest, and writes the outcomes, one row a
piece, as one part of the ledger named by the query and the batch. The part is the ledger's entry and
the result at once, so no stop can fall between them; a repeated batch replaces its own part. A piece that
failed has an ``error``; it is tried again by the next run, and its error goes when it succeeds.
A new query over the same pieces, without the checkpoint of the old one, skips what is finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import events as ev


class Ledger:
    """``keys`` name a piece; outcomes have ``keys``, ``columns`` of a result, and error."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = f"{schema}, error string, tried_at timestamp"
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.folder}/part=start")

    def entries(self) -> DataFrame:
        """All outcomes, of every try."""
        return self.spark.read.schema(self.schema + ", part string").option("basePath", self.folder).parquet(self.folder).drop("part")

    def finished(self) -> DataFrame:
        return self.entries().where("error is null").drop("error", "tried_at")

    def failed(self) -> DataFrame:
        """The last failure of each piece that has not been finished since."""
        bad = self.entries().where("error is not null").join(self.finished().select(*self.keys), self.keys, "left_anti")
        return ev.latest(bad, self.keys, ["tried_at", "error"]).select(*self.keys, "error", "tried_at")

    def work(self, batch: DataFrame, part: str, do: Callable[[DataFrame], DataFrame]) -> None:
        """``do`` gives outcomes of pieces (keys, result columns, and maybe error); those of ``part`` replace an earlier write of it."""
        others = self.entries_but(part).where("error is null").select(*self.keys)
        outcomes = do(batch.join(others, self.keys, "left_anti"))
        if "error" not in outcomes.columns:
            outcomes = outcomes.withColumn("error", F.lit(None).cast("string"))
        names = [field.strip().split(" ")[0] for field in self.schema.split(", ")]
        outcomes.withColumn("tried_at", F.current_timestamp()).select(*names).write.mode("overwrite").parquet(f"{self.folder}/part={part}")

    def entries_but(self, part: str) -> DataFrame:
        return self.spark.read.schema(self.schema + ", part string").option("basePath", self.folder).parquet(self.folder).where(F.col("part") != part).drop("part")

    def run(self, pieces: DataFrame, checkpoint: str, do: Callable[[DataFrame], DataFrame]):
        """Works on a stream of pieces."""

        def each(batch: DataFrame, number: int) -> None:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
            self.work(batch, f"{query}-{number}", do)

        return pieces.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def totals(self) -> DataFrame:
        """One row: pieces finished, pieces failed, tries."""
        done = self.finished().select(*self.keys).distinct().agg(F.count("*").alias("finished"))
        bad = self.failed().agg(F.count("*").alias("failed"))
        tries = self.entries().agg(F.count("*").alias("tries"))
        return done.join(bad).join(tries)  # single rows
