"""Compaction in place: which hours it takes, what it keeps, and runs that were broken off."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlake.sources import lake

SCHEMA = "event_id string, time timestamp, class_uid int, status string"


def written(spark, path, n, rows, batch=None):
    """``n`` files an hour, each with all of ``rows`` (event_id, hour, class)."""
    for k in range(n):
        df = spark.createDataFrame(rows, "event_id string, h int, class_uid int").coalesce(1)
        df = df.select("event_id", F.make_timestamp(F.lit(2024), F.lit(5), F.lit(6), "h", F.lit(0), F.lit(0)).alias("time"), F.lit(None).cast("timestamp").alias("recv_time"), "class_uid", F.lit(f"file {k}").alias("status"))
        if batch is None:
            lake.write(df, path)
        else:
            lake.partitioned(df).withColumn("batch_id", F.lit(batch + k)).write.partitionBy("class_uid", "dt", "hour", "batch_id").mode("append").parquet(path)


def files(path):
    return Counter(os.path.relpath(d, path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_hours_with_enough_settled_files(spark, tmp_path):
    path = str(tmp_path / "lake")
    written(spark, path, 5, [("a", 1, 1), ("b", 1, 1), (None, 1, 1)])
    written(spark, path, 3, [("c", 2, 1)])
    written(spark, path, 4, [("d", 3, 2)])
    names = {p: sorted(os.listdir(os.path.join(path, p))) for p in files(path)}
    old = 1_600_000_000
    for d, _, found in os.walk(path):
        for n in found:
            if n.endswith(".parquet") and "class_uid=2" not in d:
                os.utime(os.path.join(d, n), (old, old))
    assert lake.compact_settled(spark, path) == 5
    got = files(path)
    assert got == {"class_uid=1/dt=2024-05-06/hour=01": 1, "class_uid=1/dt=2024-05-06/hour=02": 3, "class_uid=2/dt=2024-05-06/hour=03": 4}
    assert all(sorted(os.listdir(os.path.join(path, p))) == names[p] for p in got if got[p] > 1) and not os.path.exists(f"{path}/_compaction")
    rows = spark.read.parquet(path).filter("hour = 1").collect()
    assert Counter(r.event_id for r in rows) == {"a": 1, "b": 1, None: 5}
    # Nothing more to do; with the other class's files settled too, they go, and only they.
    assert lake.compact_settled(spark, path) == 0
    assert lake.compact_settled(spark, path, settle_ms=-5_000) == 4 and files(path)["class_uid=2/dt=2024-05-06/hour=03"] == 1


def test_a_large_hour_is_written_once(spark, tmp_path):
    """What a compaction made counts as one file, so three new ones beside it are enough, and none or two aren't."""
    path = str(tmp_path / "lake")
    written(spark, path, 4, [("a", 1, 1)])
    folder = f"{path}/class_uid=1/dt=2024-05-06/hour=01"
    for n in list(os.listdir(folder)):
        if n.endswith(".parquet"):
            os.rename(f"{folder}/{n}", f"{folder}/merged-{n}")
    for crc in [n for n in os.listdir(folder) if n.endswith(".crc")]:
        os.remove(f"{folder}/{crc}")
    assert lake.compact_settled(spark, path, settle_ms=-60_000) == 0
    written(spark, path, 2, [("b", 1, 1)])
    assert lake.compact_settled(spark, path, settle_ms=-60_000) == 0
    written(spark, path, 1, [("b", 1, 1)])
    assert lake.compact_settled(spark, path, settle_ms=-60_000) == 7
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_many_passes_and_batches_of_a_stream(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    written(spark, path, 4, [("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("c", 3, 2)], batch=10)
    monkeypatch.setattr(lake, "HOURS_A_PASS", 3)
    assert lake.compact_settled(spark, path, settle_ms=-60_000, now_ms=None) == 16
    assert {k.rsplit("/", 1)[1] for k in files(path)} == {"batch_id=-1"} and set(files(path).values()) == {1}
    assert sorted((r.event_id, r.class_uid) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 1), ("c", 1), ("c", 2)]


@pytest.mark.parametrize("broken", ["before", "moving", "removing"])
def test_a_run_that_was_broken_off(spark, tmp_path, monkeypatch, broken):
    """Rows without id can't be told apart, so only a run that is finished rightly keeps their number."""
    path = str(tmp_path / "lake")
    written(spark, path, 4, [("a", 1, 1), (None, 1, 1), ("b", 2, 1), (None, 2, 1)])
    finish = lake._finish

    def stop(spark, path):
        work = f"{path}/_compaction"
        if os.path.exists(f"{work}/rows/_SUCCESS"):
            if broken == "before":
                os.remove(f"{work}/rows/_SUCCESS")
            rows = lake.matching(spark, f"{work}/rows/class_uid=*/dt=*/hour=*/*.parquet")
            for i, found in enumerate(x.removeprefix("file:") for x in rows):
                if broken == "removing" or broken == "moving" and i == 0:
                    to = path + found.split("/_compaction/rows", 1)[1]
                    os.rename(found, os.path.join(os.path.dirname(to), "merged-" + os.path.basename(to)))
            if broken == "removing":
                first = spark.read.parquet(f"{work}/files").first().file
                os.remove(f"{path}/{first}")
            raise KeyboardInterrupt
        return finish(spark, path)

    monkeypatch.setattr(lake, "_finish", stop)
    with pytest.raises(KeyboardInterrupt):
        lake.compact_settled(spark, path, settle_ms=-60_000)
    monkeypatch.setattr(lake, "_finish", finish)
    lake.compact_settled(spark, path, settle_ms=-60_000)
    assert Counter(r.event_id for r in spark.read.parquet(path).collect()) == {"a": 1, "b": 1, None: 8}
    assert set(files(path).values()) == {1} and lake.compact_settled(spark, path, settle_ms=-60_000) == 0
