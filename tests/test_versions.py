"""Publications of several tables: both or none, and nothing for what is there already."""

import pytest
from pyspark.sql import functions as F

from folioloom.operators import audit
from folioloom.sources import versions


def place(tmp_path):
    return f"file://{tmp_path}/store"


def test_versions_and_states(spark, tmp_path):
    store = versions.Versions(spark, place(tmp_path), keep=2)
    assert store.state() is None
    with pytest.raises(LookupError):
        store.read("a")
    rows = spark.range(10).withColumn("x", F.array(F.lit(1)))
    assert store.publish({"a": rows, "b": spark.range(3)}) == (1, "created")
    assert store.publish({"b": spark.range(3).repartition(3), "a": rows.orderBy(F.desc("id"))}) == (1, "unchanged")
    old = store.state()
    assert store.publish({"a": rows.where("id < 9"), "b": spark.range(3)}) == (2, "changed")
    assert (store.read("a").count(), store.read("a", old).count(), store.read("b").count()) == (9, 10, 3)
    assert store.publish({"a": rows, "b": spark.range(3)}) == (3, "changed")
    assert [s["version"] for s in store.history()] == [3, 2]
    assert len(list((tmp_path / "store/data").iterdir())) == 2
    with pytest.raises(RuntimeError, match="version 3 is current"):
        store.publish({"a": rows}, expected=2)


def test_a_table_may_come_from_the_version_before(spark, tmp_path):
    store = versions.Versions(spark, place(tmp_path))
    store.publish({"a": spark.range(2)})
    for n in (3, 4):
        store.publish({"a": store.read("a").union(spark.range(n, n + 1))})
    assert sorted(r.id for r in store.read("a").collect()) == [0, 1, 3, 4]


def test_failures_leave_the_pair_before(spark, tmp_path, monkeypatch):
    store = versions.Versions(spark, place(tmp_path))
    store.publish({"publishes": spark.range(2), "books": spark.range(5)})
    before = store.state()
    broken = spark.range(6).select(F.when(F.col("id") > 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"publishes": spark.range(3), "books": broken})
    assert store.state() == before and len(list((tmp_path / "store/data").iterdir())) == 1
    monkeypatch.setattr(store, "_swap", lambda name: (_ for _ in ()).throw(OSError("no rename")))
    with pytest.raises(OSError):
        store.publish({"publishes": spark.range(3), "books": spark.range(6)})
    assert store.state() == before and store.read("publishes").count() == 2 and store.read("books").count() == 5


def test_digest_tells_rows_apart(spark):
    one = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None)], "i int, t string, m map<string,int>")
    again = spark.createDataFrame([(2, None, None), (1, "a", {"k": 1})], "i int, t string, m map<string,int>")
    assert versions.digest(one) == versions.digest(again)
    others = [one.limit(1), one.union(one.limit(1)), one.withColumn("t", F.upper("t")), one.withColumn("m", F.lit(None).cast("map<string,int>")), one.withColumnRenamed("t", "u")]
    assert len({versions.digest(x)[1] for x in [one, *others]}) == 6
    assert versions.digest(one.limit(0))[0] == 0


RELEASES = "book_id long, result string, remote_status string, slug string, error string, finished_at timestamp"


def test_recorded_releases(spark, tmp_path):
    import datetime as dt

    books = spark.createDataFrame([(1, "draft", None, None, "old"), (2, "draft", None, None, None)], "book_id long, publish_state string, published_slug string, published_at_remote timestamp, last_error string")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    first = spark.createDataFrame([(1, "failed", "draft", "one", "boom", at(1)), (1, "success", "published", "one", None, at(2)), (9, "success", "published", "nine", None, at(3))], RELEASES)
    store = versions.Versions(spark, place(tmp_path))
    store.publish({"publishes": first.limit(0), "books": books})
    for expected in ("changed", "unchanged"):
        log, now = audit.recorded(store.read("publishes"), store.read("books"), first)
        assert store.publish({"publishes": log, "books": now})[1] == expected
    assert store.read("publishes").count() == 2  # that of a book that is not there is refused with its pair
    found = {r.book_id: r for r in store.read("books").collect()}
    assert (found[1].publish_state, found[1].published_slug, found[1].published_at_remote, found[1].last_error) == ("success", "one", at(2), None)
    assert found[2].publish_state == "draft"
