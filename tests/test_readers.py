"""Timed rules on streams: the batch twins' results for any split into batches, late rows apart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import events as ev
from folioloom.streaming import events as stream
from folioloom.streaming import readers

START = dt.datetime(2024, 1, 1)


def made(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        who = rng.randrange(4)
        at = START + dt.timedelta(milliseconds=rng.choice([100, 250, 1000]) * rng.randrange(1, 900))
        rows.append((k, at, str(who) if who else None, f"anon-{k % 2}", "book_view", 1, 1, rng.randrange(0, 101)))
    return rows


def end(k):
    """An event long after all others, whose reader is no one else."""
    return (k, START + dt.timedelta(days=3), "last", None, "book_view", 1, 1, 0)


def arrivals(rows, seed, lateness):
    """Batches in which no event is later than ``lateness`` seconds behind the newest before it."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1].timestamp() + rng.random() * lateness * 0.9)
    out, at = [], 0
    while at < len(order):
        n = rng.randint(1, 120)
        out.append(order[at : at + n])
        at += n
    return [*out, [end(10_000)], [end(10_001)]]


def run(spark, tmp_path, batches, build):
    folder, place = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        started = build(stream.source(spark, folder))
        readers.write_verdicts(started, place, f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda name: spark.read.parquet(f"{place}/{name}").where("key not like '%last'").collect()
    return read("verdicts"), read("late")


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_for_any_split(spark, tmp_path, seed):
    rows = made(seed)
    expected = {r.event_id: r.accepted for r in ev.admit(spark.createDataFrame(rows, stream.EVENT_SCHEMA), 3, 20).collect()}
    found, late = run(spark, tmp_path, arrivals(rows, seed, 60), lambda s: readers.admitted(s, 3, 20, "60 seconds"))
    assert not late and {r.event_id: r.verdict == "accepted" for r in found} == expected
    assert 0 < sum(expected.values()) < len(expected)


def test_throttling(spark, tmp_path):
    rows = made(3, 150)
    expected = {r.event_id for r in ev.throttled(spark.createDataFrame(rows, stream.EVENT_SCHEMA)).collect()}
    found, _ = run(spark, tmp_path, arrivals(rows, 3, 60), lambda s: readers.throttled(s, lateness="60 seconds"))
    assert {r.event_id for r in found if r.verdict == "accepted"} == expected


def test_debouncing_sends_a_silent_reader_s_last_event(spark, tmp_path):
    rows = made(4, 150)
    batch = spark.createDataFrame(rows, stream.EVENT_SCHEMA).withColumn("who", ev.reader_key())
    expected = {r.event_id for r in ev.debounced(batch, "who").collect()}
    found, _ = run(spark, tmp_path, arrivals(rows, 4, 60), lambda s: readers.debounced(s, ev.reader_key(), lateness="60 seconds"))
    assert {r.event_id for r in found} == expected
    assert {max((r for r in rows if r[2] == who), key=lambda r: (r[1], r[0]))[0] for who in "123"} <= expected


def test_checkpoints(spark, tmp_path):
    rows = made(5, 150)
    as_scrolls = lambda e: e.select("event_id", "created_at", ev.reader_key().alias("session_id"), F.col("reading_seconds").cast("int").alias("percent"))
    expected = {(r.session_id, r.event_type, r.first_at) for r in ev.scroll_checkpoints(as_scrolls(spark.createDataFrame(rows, stream.EVENT_SCHEMA))).collect()}
    found, _ = run(spark, tmp_path, arrivals(rows, 5, 60), lambda s: readers.scroll_checkpoints(as_scrolls(s), lateness="60 seconds"))
    assert {(r.key, r.mark, r.created_at) for r in found} == expected and len(found) == len(expected)


def test_late_events_go_to_their_own_table(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    one = lambda k, s: (k, at(s), "1", None, "book_view", 1, 1, 0)
    batches = [[one(1, 0), one(2, 100)], [one(3, 130)], [one(4, 20), one(5, 95)], [end(6)], [end(7)]]
    found, late = run(spark, tmp_path, batches, lambda s: readers.admitted(s, 9, 60, "10 seconds"))
    assert sorted(r.event_id for r in late) == [4, 5] and sorted(r.event_id for r in found) == [1, 2, 3]


def test_state_is_dropped():
    rule = readers.Admission(2, 60)
    state, _ = rule.step(None, (5_000_000, 1, ""))
    assert rule.expires(state) == 65_001 and rule.settle(state, 65_001) == (None, []) and rule.settle(state, 65_000)[0]
    quiet = readers.Debounce(500)
    state, out = quiet.step(None, (1_000_000, 1, "m"))
    assert out == [] and quiet.settle(state, 1499) == (state, []) and quiet.settle(state, 1500) == (None, [(1_000_000, 1, "m", "sent")])
    once = readers.Checkpoints(10)
    state, out = once.step(None, (0, 1, "60"))
    assert [v[2] for v in out] == ["chapter_25", "chapter_50"]
    assert once.step(state, (9_000_000, 2, "60"))[1] == [] and len(once.step(state, (11_000_000, 2, "60"))[1]) == 2
