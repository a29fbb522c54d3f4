"""Streams against their batch twins."""

import datetime as dt
import random

import pytest

from folioloom.operators import events as ev
from folioloom.streaming import events as stream


def made(n=400):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        who = rng.randrange(5)
        at = start + dt.timedelta(seconds=rng.randrange(1800) + 1800 * (k // 100))
        rows.append((k, at, str(who) if who else None, f"0000000{who}-0000-4000-8000-000000000000", rng.choice(ev.EVENT_TYPES[:5]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, 5, -1])))
    return rows


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = made()
    for part in range(4):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.read.schema(stream.EVENT_SCHEMA).parquet(folder)


def brute(rows, quota, seconds):
    held, out = {}, {}
    for k, at, user, anon, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        who = f"user:{user}" if user else f"anonymous:{anon}"
        now = [t for t in held.get(who, []) if t >= at - dt.timedelta(seconds=seconds)]
        out[k] = len(now) < quota
        held[who] = now + [at] * out[k]
    return out


def run(frame, name, spark, folder, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_admission(spark, arrived, tmp_path):
    folder, batch = arrived
    expected = brute(made(), 3, 120)
    assert {r.event_id: r.accepted for r in ev.admit(batch, 3, 120).collect()} == expected
    rows = run(stream.admitted(stream.source(spark, folder), 3, 120), "admitted", spark, tmp_path)
    assert {r.event_id: r.accepted for r in rows} == expected
    assert 0 < sum(expected.values()) < len(expected)


def test_accepted_and_latest(spark, arrived, tmp_path):
    folder, batch = arrived
    stream.write_accepted(stream.source(spark, folder), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == ev.rejections(batch).where("rejection is null").count()
    stream.write_latest(stream.source(spark, folder, 1), f"{tmp_path}/latest", f"{tmp_path}/c2").awaitTermination()
    last = sorted((tmp_path / "latest").iterdir(), key=lambda p: int(p.name[2:]))[-1]
    assert last.name == "v=3"
    rows = batch.where("book_id is not null").select(ev.actor().alias("actor"), "book_id", "created_at", "event_id", "chapter_number")
    expected = ev.latest(rows, ["actor", "book_id"], ["created_at", "event_id"])
    assert sorted(map(tuple, spark.read.schema(expected.schema).parquet(str(last)).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_unique_readers(spark, arrived, tmp_path):
    folder, batch = arrived
    rows = run(stream.unique_readers(stream.source(spark, folder)), "uniques", spark, tmp_path, "complete")
    expected = batch.groupBy("event_type").agg(ev.F.countDistinct(ev.known_actor())).collect()
    assert {r.event_type: r.unique_readers for r in rows} == {r[0]: r[1] for r in expected}


def test_parsing(spark):
    raw = spark.createDataFrame([('{"event_id": 1, "event_type": "book_view", "book_id": 2, "anonymous_id": "aaaaaaaa-aaaa-4aaa-8aaa-aaaaaaaaaaaa"}',), ("{broken",), ('{"x": "' + "y" * 5000 + '"}',)], "value string")
    rows = stream.parsed(raw).collect()
    assert [r.event_id for r in rows] == [1, None, None]
    assert stream.accepted(stream.parsed(raw)).count() == 1


def test_report_runs(spark, arrived, tmp_path):
    _, batch = arrived
    job = stream.ReportRun("2024-01")
    with pytest.raises(RuntimeError):
        job.deliver(batch, "2024-01-01", "2024-02-01", f"{tmp_path}/r", lambda totals: (_ for _ in ()).throw(RuntimeError("mail")))
    assert job.status == "failed"
    with pytest.raises(ValueError):
        ev.purge(batch, "2024-01-02", job.status)
    seen = []
    for _ in range(2):
        job.deliver(batch, "2024-01-01", "2024-02-01", f"{tmp_path}/r", lambda totals: seen.append(totals.count()))
    assert job.status == "sent" and len(seen) == 1
    assert spark.read.parquet(f"{tmp_path}/r").agg({"event_count": "sum"}).first()[0] == 400
    kept, gone = ev.purge(batch, "2024-01-01 01:00:00", job.status)
    assert gone + kept.count() == 400 and gone > 0
    with pytest.raises(ValueError):
        job.move("failed")
