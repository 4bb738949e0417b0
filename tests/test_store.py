"""Publications are seen whole or not at all; the log tells which snapshots stand; late and repeated arrivals have a status."""

import pytest
from pyspark.sql import functions as F

from dealflow.operators import snapshots as A
from dealflow.operators.store import SnapshotStore
from dealflow.streaming.ingest import follow, ingest


def deals(spark, gp, day, at, *ids):
    d = spark.createDataFrame([(i, gp, None) for i in ids], "deal_id long, gp_name string, fund_currency string")
    d = A.long_table(d, day or "2000-01-01", "team", at or "2000-01-01 00:00:00")
    d = d if day else d.withColumn("track_record_date", F.lit(None).cast("date"))
    return d if at else d.withColumn("published_at", F.lit(None).cast("timestamp"))


def held(store):
    return sorted((r.gp_name, str(r.track_record_date), r.deal_id) for r in store.read().collect())


def test_readers_see_whole_publications(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.inventory().count() == 0
    with pytest.raises(ValueError):
        store.read()
    store.publish(deals(spark, "A", "2020-01-31", "2020-02-01 00:00:00", 1, 2).union(deals(spark, "B", "2020-01-31", "2020-02-01 00:00:00", 3)))
    before = held(store)
    # A publication of both keys that has written its data, with one partition of it gone again, and one that died before its commit.
    name, table = store.staged(deals(spark, "A", "2020-01-31", "2021-02-01 00:00:00", 9).union(deals(spark, "B", "2020-01-31", "2021-02-01 00:00:00", 8)))
    store.staged(deals(spark, "C", "2020-01-31", "2021-02-01 00:00:00", 7))
    assert held(store) == before == [("A", "2020-01-31", 1), ("A", "2020-01-31", 2), ("B", "2020-01-31", 3)]
    assert held(SnapshotStore(spark, str(tmp_path))) == before and [r.deals for r in store.inventory().orderBy("gp_name").collect()] == [2, 1]
    assert store.commit(name, table) == 2
    assert held(store) == [("A", "2020-01-31", 9), ("B", "2020-01-31", 8)]
    assert len(store.vacuum()) == 2 and held(store) == [("A", "2020-01-31", 9), ("B", "2020-01-31", 8)] and store.vacuum() == []


def test_two_publishers_and_a_replay(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    first, second = one.staged(deals(spark, "A", "2020-01-31", "2020-02-01 00:00:00", 1)), two.staged(deals(spark, "A", "2020-01-31", "2020-02-01 00:00:00", 2))
    # Both take the same number for the next one; the second finds it taken.
    stale = one.versions
    two.versions = lambda calls=[]: calls.append(1) or (stale() if len(calls) > 1 else [])
    assert one.commit(*first) == 1 and two.commit(*second) == 2
    assert held(one) == [("A", "2020-01-31", 2)]
    again = deals(spark, "G/P", None, None, 5, 5)
    assert [tuple(r) for r in one.publish(again, "batch-1").collect()] == [("G-P", "undated", False)]
    assert [tuple(r) for r in one.publish(again, "batch-1").collect()] == [("G-P", "undated", False)] and len(one.versions()) == 3
    assert [tuple(r) for r in one.publish(again).collect()] == [("G-P", "undated", True)]
    assert held(one) == [("A", "2020-01-31", 2), ("G/P", "None", 5), ("G/P", "None", 5)]
    assert one.publish(again.where("false")).count() == 0 and len(one.versions()) == 4


def test_the_log_answers_alone(spark, tmp_path):
    """A7 reads no data; X1 and S1 read the folders they need and no others."""
    store = SnapshotStore(spark, str(tmp_path))
    for day in ("2019-12-31", "2020-12-31"):
        for gp in "AB":
            store.publish(deals(spark, gp, day, "2021-02-01 00:00:00", 1, 2))
    store.publish(deals(spark, None, None, None, 3))
    assert all("/log/" in f for f in store.inventory().inputFiles())
    assert sorted((r.gp_name, str(r.track_record_date), r.deals) for r in store.inventory().collect() if r.gp_name) == [(g, d, 2) for g in "AB" for d in ("2019-12-31", "2020-12-31")]
    files = store.latest().inputFiles()
    assert files and not any("2019-12-31" in f for f in files)
    assert sorted((r.gp_name or "", r.deal_id) for r in store.latest().collect()) == [("", 3), ("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    # An ingest goes through with the data of all other keys gone.
    store.vacuum()
    part = deals(spark, "A", "2020-12-31", "2022-02-01 00:00:00", 7)
    part.write.parquet(f"{tmp_path}/in")
    for f in (tmp_path / "data").glob("*/gp_key=*/as_of=*/*.parquet"):
        f.unlink()
    ingest(spark, f"{tmp_path}/in", str(tmp_path), f"{tmp_path}/state", part.schema).awaitTermination()
    assert [r.deal_id for r in store.read(store.current().where("gp_key = 'A' AND as_of = '2020-12-31'")).collect()] == [7]


def test_columns_come_and_go(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish(deals(spark, "A", "2020-01-31", "2020-02-01 00:00:00", 1).withColumn("extra", F.lit("x")))
    store.publish(deals(spark, "B", "2020-01-31", "2020-02-01 00:00:00", 2))
    assert sorted((r.gp_name, r.extra) for r in store.read().select("gp_name", "extra").collect()) == [("A", "x"), ("B", None)]


def test_late_replayed_and_out_of_order(spark, tmp_path):
    """Of a key's publications the newest stands; each arrival has its status, whatever the batches it came in."""
    source, target = SnapshotStore(spark, f"{tmp_path}/source"), SnapshotStore(spark, f"{tmp_path}/target")
    day = "2020-01-31"

    def arrive(*parts):
        for p in parts:
            source.publish(p)
        follow(spark, f"{tmp_path}/source", f"{tmp_path}/target", f"{tmp_path}/state").awaitTermination()

    arrive(deals(spark, "A", day, "2020-02-02 00:00:00", 1), deals(spark, "B", day, "2020-02-01 00:00:00", 2))
    assert held(target) == [("A", day, 1), ("B", day, 2)]
    # Late: older than what stands. Replay: the same publication once more. Out of order within a batch: the newest counts.
    arrive(deals(spark, "A", day, "2020-02-01 00:00:00", 10), deals(spark, "A", day, "2020-02-02 00:00:00", 11))
    assert held(target) == [("A", day, 1), ("B", day, 2)]
    arrive(deals(spark, "B", day, "2020-02-05 00:00:00", 21), deals(spark, "B", day, "2020-02-03 00:00:00", 22), deals(spark, "C", day, None, 3))
    assert held(target) == [("A", day, 1), ("B", day, 21), ("C", day, 3)]
    arrive(deals(spark, "A", day, "2020-03-01 00:00:00", 12))
    assert held(target) == [("A", day, 12), ("B", day, 21), ("C", day, 3)]
    seen = spark.read.parquet(f"{tmp_path}/target/arrivals").orderBy("v")
    assert [(r.gp_key, r.status) for r in seen.collect()] == [("A", "new"), ("B", "new"), ("A", "late"), ("A", "replay"), ("B", "newer"), ("B", "late"), ("C", "new"), ("A", "newer")]
    versions = target.versions()
    follow(spark, f"{tmp_path}/source", f"{tmp_path}/target", f"{tmp_path}/other").awaitTermination()
    assert held(target) == [("A", day, 12), ("B", day, 21), ("C", day, 3)] and len(target.versions()) >= len(versions)
