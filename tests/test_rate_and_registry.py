"""Sources reloaded between batches, drops that the ledger counts, and rate caps against a plain token bucket."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from eventlake.operators.mapping import Source
from eventlake.streaming import pipeline, rate, registry

T0 = 1_790_000_000_000


def source(name, mark):
    return Source(name, [("any", [("regex", f"^{mark}"), ("regex", f"^<\\d+>{mark}")])], "kv", {}, select=[("act", "login", "authentication")], otherwise="network_activity", classes={c: {"user.name": "who", "time": {"from": "at", "pipe": [("strptime", {"fmt": "yyyy"})]}} for c in ("network_activity", "authentication")})


def landed(folder, k, rows):
    folder.mkdir(exist_ok=True)
    f = folder / f"{k:03}.json"
    f.write_text("\n".join(json.dumps(dict(zip(("raw_id", "recv_ms", "line"), r, strict=True))) for r in rows))
    os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, tmp_path, sources, **more):
    pipeline.start(pipeline.raw_stream(spark, str(tmp_path / "in"), 1), sources, str(tmp_path / "out"), once=True, **more).awaitTermination()


def ledger(spark, tmp_path):
    return {(r.batch_id, r.field): r.n for r in spark.read.parquet(str(tmp_path / "out" / "ledger")).collect()}


def test_a_version_comes_back_as_it_was(spark, tmp_path):
    path, both = str(tmp_path / "reg"), [source("one", "a"), source("two", "b")]
    assert registry.load(spark, path) == [] and registry.published(spark, path) == []
    assert registry.publish(spark, both, path) == 1 and registry.publish(spark, both[:1], path) == 2
    first = registry.load(spark, path, 1)
    assert [(s.id, s.match, s.select) for s in first] == [(s.id, s.match, s.select) for s in both] and registry.published(spark, path) == [1, 2]
    assert [s.id for s in registry.load(spark, path)] == ["one"]


def test_a_source_added_between_batches(spark, tmp_path):
    """Both batches hold lines of both sources; the second source is there from the second batch on, and not in a replay of the first."""
    path, root = str(tmp_path / "reg"), str(tmp_path / "out")
    registry.publish(spark, [source("one", "a ")], path)
    of = registry.for_batches(path, root)
    landed(tmp_path / "in", 0, [("1", T0, "a who=x"), ("2", T0, "b who=y")])
    run(spark, tmp_path, of)
    registry.publish(spark, [source("one", "a "), source("two", "b ")], path)
    landed(tmp_path / "in", 1, [("3", T0, "a who=x"), ("4", T0, "b who=y")])
    run(spark, tmp_path, of)
    batch = spark.read.schema(pipeline.RAW).json(str(tmp_path / "in" / "000.json"))
    pipeline.write_batch(of, root)(batch, 0)
    found = {(r.batch_id, r.source_id, r.n) for r in spark.read.parquet(f"{root}/lake").filter("status <> 'unparsed'").groupBy("batch_id", "source_id").agg(F.count("*").alias("n")).collect()}
    assert found == {(0, "one", 1), (1, "one", 1), (1, "two", 1)}
    counts = ledger(spark, tmp_path)
    assert counts[0, "received"] == counts[1, "received"] == 2 and counts[0, "unparsed"] == 1 and (1, "unparsed") not in counts


def test_drops_and_caps_are_counted(spark, tmp_path):
    cap = rate.Cap(2, 1000, 4)
    batches = [
        [("j0", T0, "junk")],
        [(f"a{i}", T0 + i, "a who=x") for i in range(9)] + [("j1", T0, "junk"), ("b0", T0, "b who=y")],
        [(f"c{i}", T0 + 1008, "a who=x") for i in range(9)],
        [("b1", T0 + 1009, "b who=y")],
        [(f"d{i}", T0 + 60_000, "a who=x") for i in range(9)],
    ]
    for k, rows in enumerate(batches):
        landed(tmp_path / "in", k, rows)
    sources = [source("one", "a "), source("two", "b ")]
    run(spark, tmp_path, sources, drop_unparsed=True, cap=cap)
    # A batch that is run again comes to the same: rows in the view, buckets and ledger.
    before = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out" / "tail")).collect())
    again = spark.read.schema(pipeline.RAW).json(str(tmp_path / "in" / "002.json"))
    pipeline.write_batch(sources, str(tmp_path / "out"), True, cap)(again, 2)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out" / "tail")).collect()) == before
    counts = ledger(spark, tmp_path)
    lake = {r.batch_id: r.n for r in spark.read.parquet(str(tmp_path / "out" / "lake")).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    for k in range(len(batches)):
        assert counts[k, "received"] == len(batches[k]) == lake.get(k, 0) + counts.get((k, "dropped:unparsed_dropped"), 0)
        assert counts[k, "tail"] + counts[k, "skipped:tail_rate"] == lake.get(k, 0)
    # Four at once; a second later two more; after a minute four again. The other source has a bucket of its own.
    assert [counts[k, "tail"] for k in range(5)] == [0, 5, 2, 1, 4] and counts[0, "dropped:unparsed_dropped"] == 1


def test_token_bucket_over_batches(spark):
    cap, r = rate.Cap(3, 70, 11), random.Random(5)
    said = [(who, 40 * k + r.randrange(3), r.randrange(25)) for who in ("p", "q", None) for k in range(60) if r.random() < 0.7]
    got = {(x.who, x.at): x.taken for x in rate.allowed_over(spark.createDataFrame(said, "who string, at long, n long"), "who", cap).collect()}
    for who in ("p", "q", None):
        held, last = 11 * 70, None
        for _, at, n in sorted((x for x in said if x[0] == who), key=lambda x: x[1]):
            held = min(11 * 70, held + (at - last) * 3) if last is not None else held
            k = min(n, held // 70)
            held, last = held - 70 * k, at
            assert got[who, at] == k
    # The same batches one at a time, each after the state that the one before left.
    state, one = None, {}
    for at, n in ((0, 20), (100, 5), (130, 9)):
        counts = spark.createDataFrame([("p", at, n)], "who string, at long, n long")
        rows = rate.allowed(counts, "who", cap, state).collect()
        one[at] = rows[0].taken
        state = spark.createDataFrame([(x.who, x.held, x.at) for x in rows], "who string, held long, at long")
    many = rate.allowed_over(spark.createDataFrame([("p", 0, 20), ("p", 100, 5), ("p", 130, 9)], "who string, at long, n long"), "who", cap).collect()
    assert one == {x.at: x.taken for x in many} == {0: 11, 100: 4, 130: 1}
    with pytest.raises(ValueError):
        rate.Cap(0)


def test_rows_at_equal_distances(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 330, "hot").when(F.col("id") < 490, "warm").alias("who"))
    taken = spark.createDataFrame([("hot", 330, 7), ("warm", 160, 160), (None, 10, 0)], "who string, n long, taken long")
    got = {(x.who, x.id) for x in rate.let_through(df, ["who"], [F.col("id")], taken).collect()}
    assert got == {("hot", i * 330 // 7) for i in range(7)} | {("warm", i) for i in range(330, 490)}
    assert rate.let_through(df.limit(0), ["who"], [F.col("id")], taken).count() == 0
