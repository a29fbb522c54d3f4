"""Per-reader rules over streams in event-time order: admission, throttling, debouncing, checkpoints.

Events wait in a list state until the watermark has passed them, and then go through a rule by time and id. So the
result is that of the batch twin in ``operators.events``, however the events are split into batches, as long as they
come within the allowed lateness; those that come later are put out with the verdict ``late``. An event-time
timer releases what is due, the last event of a silent reader too, and drops a reader's state when it can
matter no more. What is held of a reader is the events of the allowed lateness and the rule's state; readers share
a number of groups, each one key of the state store.

Each rule is a small class: ``schema`` of its state, ``step`` for the next event, ``settle`` for what is due with no
event before ``clock`` to come, and ``expires``: when its state may go.

Needs the RocksDB state store, which ``timed`` chooses for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioloom.operators import events as ev

STORE_SETTING, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, at long, event_id long, mark string, verdict string"
COLUMNS = ["key", "at", "event_id", "mark", "verdict"]
BUFFER = "key array<string>, at array<long>, event_id array<long>, mark array<string>"
#: Groups that readers are dealt to. A group's state is read and written as a whole; a stream keeps its number for the life of its checkpoint.
GROUPS = 1024
Event = tuple[int, int, str]  # microseconds, id, mark
Verdict = tuple[int, int, str, str]  # event and verdict


class Admission:
    """``accepted`` if fewer than ``quota`` accepted events lie in the trailing window, else ``refused``."""

    schema = "held array<long>"

    def __init__(self, quota: int, seconds: int):
        self.quota, self.width = quota, seconds * 1_000_000

    def step(self, state: tuple | None, event: Event) -> tuple[tuple | None, list[Verdict]]:
        held = [t for t in (state[0] if state else []) if t >= event[0] - self.width]
        good = len(held) < self.quota
        if good:
            held.append(event[0])
        return (held,), [(*event, "accepted" if good else "refused")]

    def settle(self, state: tuple, clock: int) -> tuple[tuple | None, list[Verdict]]:
        held = [t for t in state[0] if t + self.width >= 1000 * clock]
        return ((held,) if held else None), []

    def expires(self, state: tuple) -> int:
        return (max(state[0]) + self.width) // 1000 + 1


class Debounce:
    """``sent`` for an event after which none follows within ``millis``."""

    schema = "at long, event_id long, mark string"

    def __init__(self, millis: int):
        self.millis = millis

    def step(self, state: tuple | None, event: Event) -> tuple[tuple | None, list[Verdict]]:
        quiet = state is not None and event[0] // 1000 - state[0] // 1000 >= self.millis
        return event, [(*state, "sent")] if quiet else []

    def settle(self, state: tuple, clock: int) -> tuple[tuple | None, list[Verdict]]:
        return (None, [(*state, "sent")]) if clock - state[0] // 1000 >= self.millis else (state, [])

    def expires(self, state: tuple) -> int:
        return state[0] // 1000 + self.millis


class Checkpoints:
    """``reached`` when a mark, a percentage, first reaches a share; forgotten ``idle_seconds`` after a session's last event."""

    schema = "reached array<string>, last long"

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1000

    def step(self, state: tuple | None, event: Event) -> tuple[tuple | None, list[Verdict]]:
        if state and event[0] // 1000 - state[1] > self.idle:
            state = None
        reached = list(state[0]) if state else []
        new = [name for share, name in ev.CHECKPOINTS.items() if int(event[2]) >= share and name not in reached]
        return (reached + new, event[0] // 1000), [(event[0], event[1], name, "reached") for name in new]

    def settle(self, state: tuple, clock: int) -> tuple[tuple | None, list[Verdict]]:
        return (None if clock - state[1] > self.idle else state), []

    def expires(self, state: tuple) -> int:
        return state[1] + self.idle + 1


class InOrder(StatefulProcessor):
    """Feeds a rule with each reader's events in order.

    A key of the stream is a group of readers, as each call to the state store costs as much as hundreds of events. A
    group holds its readers' waiting events as columns, a row for each frame that came, and their rule's states by reader.
    """

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", BUFFER)
        self.state = handle.getValueState("state", f"clock long, keys array<string>, states array<struct<{self.rule.schema}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            late = frame["at"] // 1000 < clock
            if late.any():
                yield frame[late].assign(verdict="late")[COLUMNS]
                frame = frame[~late]
            if len(frame):
                self.buffer.appendValue(tuple(frame[c].tolist() for c in COLUMNS[:-1]))
                first = min(int(frame["at"].min()), first or 1 << 63)
        if first is not None:
            self.handle.registerTimer(max(clock, first // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs()
        before = self.state.get() if self.state.exists() else (None, [], [])
        if before[0] == clock:
            return  # another timer of the group came before
        states = dict(zip(before[1], map(tuple, before[2]), strict=True))
        waiting = sorted(event for held in self.buffer.get() for event in zip(*held, strict=True))
        left, out, touched = [], [], set()
        for event in waiting:
            if event[1] // 1000 >= clock:
                left.append(event)
                continue
            reader = event[0]
            states[reader], told = self.rule.step(states.get(reader), (event[1], event[2], event[3]))
            out += [(reader, *t) for t in told]
            touched.add(reader)
        still = {event[0] for event in left}
        for reader, state in list(states.items()):
            if reader not in still and (reader in touched or self.rule.expires(state) <= clock):
                states[reader], told = self.rule.settle(state, clock)
                out += [(reader, *t) for t in told]
            if states[reader] is None:
                del states[reader]
        if touched:
            if left:
                self.buffer.put([tuple(map(list, zip(*left, strict=True)))])
            else:
                self.buffer.clear()
        if states:
            self.state.update((clock, list(states), [tuple(s) for s in states.values()]))
        elif before[0] is not None:
            self.state.clear()
        due = [event[1] // 1000 + 1 for event in left] + [self.rule.expires(s) for reader, s in states.items() if reader not in still]
        if due:
            self.handle.registerTimer(max(clock + 1, min(due)))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def timed(events: DataFrame, key: Column, rule, mark: Column | None = None, at: str = "created_at", lateness: str = "1 minute", groups: int = GROUPS) -> DataFrame:
    """(key, event_id, created_at, mark, verdict) of a stream's events under a rule. Events without a key are left out."""
    spark = events.sparkSession
    if spark.conf.get(STORE_SETTING, "").rpartition(".")[2] != STORE.rpartition(".")[2]:
        spark.conf.set(STORE_SETTING, STORE)
    # the time goes on as a number: Spark would drop late rows by its column, without a word
    rows = events.withWatermark(at, lateness).select(
        key.cast("string").alias("key"), F.unix_micros(at).alias("at"), F.col("event_id").cast("long").alias("event_id"), (F.lit("") if mark is None else F.coalesce(mark.cast("string"), F.lit(""))).alias("mark")
    )
    found = rows.where("key is not null and at is not null").withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("_group").transformWithStateInPandas(InOrder(rule), OUTPUT, "append", "EventTime")
    return found.select("key", "event_id", F.timestamp_micros("at").alias(at), "mark", "verdict")


def admitted(events: DataFrame, quota: int = 120, seconds: int = 60, lateness: str = "1 minute") -> DataFrame:
    """Verdicts of ``events.admit`` on a stream: accepted, refused or late."""
    return timed(events, ev.reader_key(), Admission(quota, seconds), lateness=lateness)


def throttled(events: DataFrame, seconds: int = 12, lateness: str = "1 minute") -> DataFrame:
    """``events.throttled`` on a stream: accepted events are those to send."""
    return timed(events, ev.reader_key(), Admission(1, seconds), lateness=lateness)


def debounced(events: DataFrame, key: Column, millis: int = 500, lateness: str = "1 minute") -> DataFrame:
    """``events.debounced`` on a stream."""
    return timed(events, key, Debounce(millis), lateness=lateness)


def scroll_checkpoints(scrolls: DataFrame, session: str = "session_id", percent: str = "percent", idle_seconds: int = 86_400, lateness: str = "1 minute") -> DataFrame:
    """``events.scroll_checkpoints`` on a stream: mark is the event type that is reached."""
    return timed(scrolls, F.col(session), Checkpoints(idle_seconds), F.col(percent), lateness=lateness)


def write_verdicts(verdicts: DataFrame, folder: str, checkpoint: str):
    """Verdicts into ``folder/verdicts``, late events into a table of their own, ``folder/late``; by batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, wanted in (("verdicts", "verdict <> 'late'"), ("late", "verdict = 'late'")):
                kept.where(wanted).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return verdicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
