import json

import pytest
from pyspark.sql import functions as F

from eventlake.operators import features, integrity, normalize, validate
from eventlake.operators.rows import first_by_key, stride_sample
from eventlake.plans import catalog
from eventlake.schema import GOLD
from eventlake.sources import lake
from eventlake.streaming import pipeline

LINE = '<189>devname="FW" devid="D" logid="1" type="traffic" level="warning" eventtime=1790000467000000000 srcip=10.0.0.1 srcport=5 dstip=10.0.0.2 dstport=443 proto=6 action="deny" duration=2 sentbyte=7 note="n"'


def gold(spark, *lines):
    raw = spark.createDataFrame([(f"r{i}", 1_790_000_000_000 + i, x) for i, x in enumerate(lines)], pipeline.RAW)
    return normalize.normalize(normalize.envelope(raw, "line", "raw_id", "recv_ms"), [catalog.FIREWALL])


def test_a_line_becomes_a_row(spark):
    row = gold(spark, LINE).first()
    assert (row.class_uid, row.action_id, row.severity_id, row.src_ip, row.dst_port, row.proto_name, row.bytes_out, row.duration_ms) == (4001, 2, 2, "10.0.0.1", 443, "tcp", 7, 2000)
    assert row.status == "parsed" and row.device_host == "FW" and row.raw_sha256
    assert json.loads(row.unmapped) == {"logid": "1", "type": "traffic", "note": "n"}
    assert round(row.coverage, 4) == round(11 / 15, 4)
    assert json.loads(row.event)["src_endpoint"] == {"ip": "10.0.0.1", "port": 5}


def test_no_line_is_lost(spark):
    rows = gold(spark, LINE, "no source knows 17", LINE.replace("eventtime=", "et="), "").collect()
    assert sorted(r.status for r in rows) == ["parsed", "partial", "unparsed", "unparsed"]
    assert gold(spark, LINE).schema.simpleString() == GOLD.simpleString()


def test_lake_rules(spark):
    good = gold(spark, LINE, "junk").select(validate.violations(validate.lake_rules()).alias("v")).collect()
    assert [r.v for r in good] == [[], []]
    bad = gold(spark, LINE).withColumn("dst_port", F.lit(70000)).withColumn("src_ip", F.lit("x"))
    assert bad.select(validate.violations(validate.lake_rules()).alias("v")).first().v == ["ip_invalid", "port_range"]


def test_written_and_pruned(spark, tmp_path):
    lake.write(gold(spark, LINE, "junk"), str(tmp_path / "lake"))
    df = lake.scan(spark, str(tmp_path / "lake"), 1_790_000_467_000, 1_790_000_467_000, 4001)
    assert [r.src_ip for r in df.collect()] == ["10.0.0.1"]
    assert "PartitionFilters: [isnotnull(class_uid" in df._jdf.queryExecution().toString()
    assert lake.event(spark, str(tmp_path / "lake"), "r1:0").first().status == "unparsed"
    lake.write(gold(spark, LINE), str(tmp_path / "lake"))
    lake.compact(spark, str(tmp_path / "lake"), str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 2
    hours = [{p.name for p in (tmp_path / x).glob("class_uid=*/dt=*/hour=*")} for x in ("lake", "compacted")]
    assert hours[0] == hours[1]
    lake.export(spark.read.parquet(str(tmp_path / "compacted")), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_replay_numbers_equal_lines(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a\r\na\n\nb")
    rows = lake.replay(spark, str(tmp_path / "x.log")).collect()
    assert sorted(r.line for r in rows) == ["a", "a", "b"] and len({r.raw_id for r in rows}) == 3


def test_stream_replays_without_loss(spark, tmp_path):
    landing, root = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for i in range(3):
        (landing / f"{i}.json").write_text("\n".join(json.dumps({"raw_id": f"{i}-{j}", "recv_ms": 1_790_000_000_000, "line": LINE if j else "junk"}) for j in range(4)))
    for _ in range(2):
        pipeline.start(pipeline.raw_stream(spark, str(landing), 1), [catalog.FIREWALL], str(root), once=True).awaitTermination()
    assert spark.read.parquet(f"{root}/raw").count() == spark.read.parquet(f"{root}/lake").select("event_id").distinct().count() == 12
    batch = spark.read.json(str(landing / "0.json"), schema=pipeline.RAW)
    pipeline.write_batch([catalog.FIREWALL], str(root))(batch, 0)  # a replayed batch replaces itself
    ledger = {r.field: r.n for r in spark.read.parquet(f"{root}/ledger").groupBy("field").agg(F.sum("n").alias("n")).collect()}
    assert ledger["received"] == ledger["parsed"] + ledger["unparsed"] and ledger["received"] >= 12


def test_tampering_is_found_in_its_block(spark):
    raw = spark.createDataFrame([("s", i, f"line {i}") for i in range(25)], "shard string, n int, data string")
    stored = integrity.frames(raw, "shard", [F.col("n")], "data", 10).cache()
    chained = integrity.chain(integrity.block_hashes(stored, "shard")).cache()
    ok = integrity.verify(stored, chained, "shard", "data").collect()
    assert len(ok) == 3 and all(r.hash_ok and r.link_ok and r.number_ok and not r.bad_frames for r in ok)
    touched = stored.withColumn("data", F.when(F.col("n") == 12, "lie").otherwise(F.col("data")))
    bad = [r for r in integrity.verify(touched, chained, "shard", "data").collect() if r.bad_frames]
    assert [(r.block, r.bad_frames) for r in bad] == [(1, 1)]
    cut = [r for r in integrity.verify(stored, chained.filter("block <> 1"), "shard", "data").collect() if not (r.link_ok and r.number_ok)]
    assert sorted(r.block for r in cut) == [1, 2]  # the block without a link, and the one that no longer follows


def test_a_scan_is_flagged(spark):
    calm = [(m * 60_000 + s, f"10.0.0.{s}", f"d{m % 3}", 443, 4001, False, 10, False, "a", f"{m}-{s}") for m in range(40) for s in range(3)]
    scan = [(20 * 60_000 + i, "10.0.0.99", f"d{i}", i, 4001, True, 0, False, "a", f"x{i}") for i in range(500)]
    rows = spark.createDataFrame(calm + scan, "t_ms long, src string, dst string, dport int, cls int, deny boolean, bytes_out long, auth_fail boolean, source string, ref string")
    made = features.vector(features.windows(rows))
    columns = [f"v_{f}" for f in features.FEATURES]
    scored = features.robust_z(features.score_forest(made, features.fit_forest(made, columns), columns), columns, list(features.FLOORS))
    found = features.findings(features.flag(scored, 0.6, [f"z_{c}" for c in columns]), "m").collect()
    assert [r.src_ip for r in found] == ["10.0.0.99"] and len(found[0].refs) == 20 and len(found[0].event_id) == 20


@pytest.mark.parametrize("n", [0, 5, 10, 37])
def test_stride(spark, n):
    found = [r.id for r in stride_sample(spark.range(n), [F.col("id").asc()], 10).orderBy("id").collect()]
    assert found == (list(range(n)) if n <= 10 else [i * n // 10 for i in range(10)])


def test_rows_without_key_stay(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert sorted(r.v for r in first_by_key(df, "k", [F.col("v").asc()]).collect()) == [1, 3, 4]


def test_forest_samples_windows_not_values(spark):
    made = spark.range(6000).select(F.col("id").cast("string").alias("src"), F.lit(0).alias("window_start"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") + 100.0).alias("v"))
    seen = []
    forest, features.Forest = features.Forest, lambda points, **_: seen.append(points)
    try:
        for seed in range(5):
            features.fit_forest(made, ["v"], sample=600, seed=seed)
    finally:
        features.Forest = forest
    assert all(len(x) == 600 and 0.25 < (x == 7.0).mean() < 0.42 for x in seen)
