"""Structured Streaming forms of event ingestion, admission, latest positions and rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioloom.operators import events as ev
from folioloom.operators import ingest

EVENT_SCHEMA = "event_id long, created_at timestamp, user_id string, anonymous_id string, event_type string, book_id long, chapter_number int, reading_seconds long"


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events arriving as parquet files below ``path``."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def parsed(raw: DataFrame, column: str = "value", limit: int = 4096) -> DataFrame:
    """Events out of JSON texts of at most ``limit`` bytes; what cannot be read becomes a row of nulls."""
    fit = F.when(F.octet_length(column) <= limit, F.col(column).cast("string"))
    return raw.select(F.from_json(fit, EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("_e")).select("_e.*")


def accepted(events: DataFrame) -> DataFrame:
    """Events that break no rule."""
    return ev.rejections(events).where("rejection is null").drop("rejection")


def admitted(events: DataFrame, quota: int = 120, seconds: int = 60) -> DataFrame:
    """Greedy admission by reader. The state of a reader is the accepted times of one window; it is
    dropped when the watermark has passed them. Within a batch events go by time and id; over
    batches by arrival."""
    key = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), "user_id")).otherwise(F.concat(F.lit("anonymous:"), F.coalesce("anonymous_id", F.lit(""))))
    width = pd.Timedelta(seconds=seconds)

    def step(actor: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [pd.Timestamp(t, unit="us") for t in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["created_at", "event_id"])
        verdicts = []
        for at in rows["created_at"]:
            held = [t for t in held if t >= at - width]
            verdicts.append(len(held) < quota)
            if verdicts[-1]:
                held.append(at)
        if held:
            state.update(([t.value // 1000 for t in held],))
            state.setTimeoutTimestamp(max(int(held[-1].value // 1_000_000) + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "actor": actor[0], "accepted": verdicts})

    rows = events.withWatermark("created_at", f"{seconds} seconds").select(key.alias("actor"), "event_id", "created_at")
    return rows.groupBy("actor").applyInPandasWithState(step, "event_id long, actor string, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reader_days(events: DataFrame) -> DataFrame:
    """Events by type and day, updated as they come; late ones within a day count."""
    return events.withWatermark("created_at", "1 day").groupBy(F.window("created_at", "1 day").alias("day"), "event_type").agg(F.count("*").alias("event_count"), F.approx_count_distinct(ev.actor()).alias("readers"))


def unique_readers(events: DataFrame) -> DataFrame:
    """Exact distinct readers by month and type, as a stream: first sight of each, then a count."""
    month = F.date_trunc("month", "created_at").alias("period_start")
    return events.select(month, "event_type", ev.known_actor().alias("actor")).where("actor is not null").dropDuplicates().groupBy("period_start", "event_type").agg(F.count("*").alias("unique_readers"))


def write_latest(events: DataFrame, path: str, checkpoint: str):
    """Keeps the latest position of each (reader, book) as snapshots ``path/v=<batch>``.

    Every batch merges with the snapshot before it and writes a new one, so none is read while it is
    overwritten; a repeated batch writes the same snapshot again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.where("book_id is not null").select(ev.actor().alias("actor"), "book_id", "created_at", "event_id", "chapter_number")
        new = ev.latest(rows, ["actor", "book_id"], ["created_at", "event_id"])
        if number:
            old = batch.sparkSession.read.schema(new.schema).parquet(f"{path}/v={number - 1}")
            new = ev.latest(old.unionByName(new), ["actor", "book_id"], ["created_at", "event_id"])
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_accepted(events: DataFrame, path: str, checkpoint: str):
    """Appends valid events to ``path``."""
    return accepted(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_progress(events: DataFrame) -> DataFrame:
    """The first event of each type by session: fired once, however often it is sent."""
    return events.withWatermark("created_at", "1 day").dropDuplicates(["session_id", "event_type"])


class ReportRun:
    """The state of a month's report: pending, then sent or failed. Only a sent month may be purged;
    events that come after that are never rolled up."""

    NEXT = {"pending": {"sent", "failed"}, "failed": {"sent", "failed"}, "sent": set()}

    def __init__(self, period: str, status: str = "pending"):
        self.period, self.status = period, status

    def move(self, status: str) -> None:
        if status not in self.NEXT[self.status]:
            raise ValueError(f"a {self.status} report cannot become {status}")
        self.status = status

    def deliver(self, events: DataFrame, start: str, end: str, path: str, send) -> None:
        """Roll up, write, send; a failure keeps the events and may be tried again."""
        if self.status == "sent":
            return
        rollups = ev.rollup_period(events, start, end)
        ev.write_rollup(rollups, path)
        try:
            send(ev.event_totals(rollups))
        except Exception:
            self.move("failed")
            raise
        self.move("sent")


def withdraw(saved: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Saved rows without those whose key was withdrawn."""
    return ingest.delete_by_key(saved, gone, key)[0]
