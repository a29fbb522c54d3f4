"""Monthly reports whose state is a table: it survives the driver.

``runs`` (period_start, status, error, sent_at) and ``rollups`` are published together (``sources.versions``). A month is
pending, then sent or failed; a failed one may be tried again, a sent one never changes. Events arrive as a stream;
those of a month that was sent are set aside in a table of their own and counted, as no report will hold them.
A month is closed between two runs of the stream, not during one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import events as ev
from folioloom.sources.versions import Versions

from .events import EVENT_SCHEMA, ReportRun

RUNS = "period_start date, status string, error string, sent_at timestamp"
ROLLUPS = "period_start date, period_end date, book_id long, event_type string, event_count long, unique_readers long"


class MonthlyReports:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Versions(spark, f"{self.folder}/reports")
        if self.store.state() is None:
            self.store.publish({"runs": spark.createDataFrame([], RUNS), "rollups": spark.createDataFrame([], ROLLUPS)})
        for name in ("open", "late"):
            spark.createDataFrame([], EVENT_SCHEMA).write.mode("ignore").parquet(f"{self.folder}/{name}/part=start")

    def runs(self) -> DataFrame:
        return self.store.read("runs")

    def rollups(self) -> DataFrame:
        return self.store.read("rollups")

    def events(self, name: str) -> DataFrame:
        """``open`` events, or those that came ``late``."""
        return self.spark.read.schema(EVENT_SCHEMA + ", part string").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").drop("part")

    def ingest(self, events: DataFrame, checkpoint: str):
        """Files a stream's events under open or late."""

        def each(batch: DataFrame, number: int) -> None:
            part = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
            sent = self.runs().where("status = 'sent'").select(F.col("period_start").alias("_month"))  # a row a month
            month = F.date_trunc("month", "created_at").cast("date")
            split = batch.withColumn("_month", month).join(F.broadcast(sent.withColumn("_sent", F.lit(True))), "_month", "left").persist()
            try:
                for name, wanted in (("open", F.col("_sent").isNull()), ("late", F.col("_sent").isNotNull())):
                    split.where(wanted).select(*batch.columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/part={part}")
            finally:
                split.unpersist()

        return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _status(self, period: str) -> str | None:
        row = self.runs().where(F.col("period_start") == F.lit(period).cast("date")).first()
        return row["status"] if row else None

    def _move(self, period: str, status: str, rollups: DataFrame, error: str | None = None) -> None:
        others = self.runs().where(F.col("period_start") != F.lit(period).cast("date"))
        own = self.spark.range(1).select(F.lit(period).cast("date").alias("period_start"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), (F.current_timestamp() if status == "sent" else F.lit(None).cast("timestamp")).alias("sent_at"))
        self.store.publish({"runs": others.unionByName(own), "rollups": rollups})

    def close(self, period: str, end: str, send: Callable[[DataFrame], None]) -> str:
        """Roll a month up, send it, and record how that went; the status. A failure keeps everything and is raised."""
        if self._status(period) == "sent":
            return "sent"
        found = ev.rollup_period(self.events("open"), period, end)
        others = self.rollups().where(F.col("period_start") != F.lit(period).cast("date"))
        self._move(period, "pending", others.unionByName(found.select(others.columns)))
        run = ReportRun(period)
        try:
            send(self.rollups().where(F.col("period_start") == F.lit(period).cast("date")))
        except Exception as error:
            run.move("failed")
            self._move(period, run.status, self.rollups(), str(error))
            raise
        run.move("sent")
        self._move(period, run.status, self.rollups())
        return run.status

    def purge(self, period: str, cutoff: str) -> tuple[DataFrame, int]:
        """Open events that stay after a purge, and how many go; refused unless the month was sent."""
        return ev.purge(self.events("open"), cutoff, self._status(period) or "pending")

    def summary(self) -> DataFrame:
        """(period_start, status, rolled_up, late, open) of every month that has a run or events."""
        month = F.date_trunc("month", "created_at").cast("date").alias("period_start")
        late = self.events("late").groupBy(month).agg(F.count("*").alias("late"))
        opened = self.events("open").groupBy(month).agg(F.count("*").alias("open"))
        rolled = self.rollups().groupBy("period_start").agg(F.sum("event_count").alias("rolled_up"))
        both = self.runs().select("period_start", "status").join(rolled, "period_start", "full").join(late, "period_start", "full").join(opened, "period_start", "full")
        count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
        return both.select("period_start", F.coalesce("status", F.lit("open")).alias("status"), count("rolled_up"), count("late"), count("open"))
