"""Numbering without one-task windows, sources by field, zones, marks, frames, integrity at both ends, merging and forests."""

import json
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.functions import net, text
from eventlake.operators import extract, features, integrity, mining, normalize, reads, rows, stats, validate
from eventlake.operators.mapping import Source
from eventlake.plans import lake_queries
from eventlake.sources import lake, vendors
from eventlake.streaming.pipeline import RAW


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()[0]


# ---------------------------------------------------------------- numbers


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_numbers_hot_groups(spark, by):
    rng = np.random.default_rng(2)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 40)), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = {r.i: (r["__before"], r["__all"]) for r in rows.running(df, by, [F.col("v"), F.col("i")]).collect()}
    groups = {}
    for g, v, i in sorted(data, key=lambda x: (x[1], x[2])):
        groups.setdefault(g if by else 0, []).append(i)
    assert got == {i: (n, len(members)) for members in groups.values() for n, i in enumerate(members)}


def test_numbering_is_spread_over_tasks(spark):
    """Rows of one table, and of one hot group, are numbered in several tasks."""
    df = spark.range(5000).withColumn("g", F.lit("hot"))
    for by in ([], ["g"]):
        made = rows.running(df, by, [F.col("id")])
        assert made.groupBy(F.spark_partition_id().alias("p")).count().filter("count > 0").count() > 1
        assert [r["__before"] for r in made.orderBy("id").collect()] == list(range(5000))


def test_medians_and_ranks(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 100):
        a, b = rng.normal(size=n).round(1), rng.integers(0, 3, n)
        df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(a, b)] + [(None, None)], "a double, b long")
        got = {r.name: r.median for r in stats.medians(df, ["a", "b"]).collect()}
        assert got == pytest.approx({"a": float(np.median(a)), "b": float(np.median(b))})
        assert stats.nearest_rank(df, "a", [0.5, 0.99]).first() == (sorted(a)[int(n * 0.5)], sorted(a)[int(n * 0.99)])


def test_partitions_are_those_of_crc32(spark):
    keys = ["", "a", "10.0.0.1", "é漢"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(rows.partition_of(F.col("k"), 16)).collect()
    assert [r[0] for r in got] == [zlib.crc32(k.encode()) % 16 for k in keys]


# ---------------------------------------------------------------- sources


def gold(spark, lines, sources, received=1_791_120_600_000):
    raw = spark.createDataFrame([(f"r{i}", received, x) for i, x in enumerate(lines)], RAW)
    return normalize.normalize(normalize.envelope(raw, "line", "raw_id", "recv_ms"), sources).orderBy("event_id").collect()


def source(match, **more):
    return Source(id="s", match=match, kind="kv", otherwise="network_activity", classes={"network_activity": {"time": {"from": "t", "pipe": ["int"]}, "src_endpoint.ip": "ip"}}, **more)


@pytest.mark.parametrize(
    ("match", "taken"),
    [
        ([("contains", "t=")], {0, 1, 2}),
        ([("contains", "t="), ("field_eq", "kind", "x")], {0}),
        ([("any", [("contains", "kind=x"), ("contains", "kind=y")])], {0, 1}),
        ([("any", [("field_eq", "kind", "x"), ("contains", "ip=3")])], {0, 2}),
        ([("field_eq", "kind", "none")], set()),
        ([], set()),
    ],
)
def test_predicates_of_fields(spark, match, taken):
    found = gold(spark, ["t=1 kind=x ip=1", "t=2 kind=y ip=2", "t=3 kind=z ip=3", "no pairs"], [source(match)])
    assert {i for i, r in enumerate(found) if r.status != "unparsed"} == taken


def test_zone_of_a_field(spark):
    line = '<189>date=2026-10-04 time=13:00:00 {} devname="F1" logid="2" type="traffic"'
    hour = 3_600_000
    at_utc = 1_791_118_800_000
    zones = {'tz="+0200"': at_utc - 2 * hour, 'tz="-0530"': at_utc + 5 * hour + hour // 2, 'tz="Europe/Berlin"': at_utc - 2 * hour, "": at_utc, 'tz=""': at_utc}
    found = gold(spark, [line.format(z) for z in zones], [vendors.FORTIGATE])
    assert [int(r.time.timestamp() * 1000) for r in found] == list(zones.values()) and {r.status for r in found} == {"parsed"}
    bad = gold(spark, [line.format('tz="Foo/Bar"'), line.format('tz="soon"')], [vendors.FORTIGATE])
    assert [r.status for r in bad] == ["partial", "partial"]
    assert "tz" not in json.loads(found[0].unmapped)


def test_event_tells_its_lineage(spark):
    known = source([("contains", "t=")], ignore={"noise": "says nothing"}, version="7")
    event = json.loads(gold(spark, ["t=5 ip=10.0.0.1 noise=n more=m"], [known])[0].event)
    assert event["lineage"]["ignored"] == {"noise": "says nothing"} and event["lineage"]["pack_version"] == "7" and event["lineage"]["status"] == "parsed"
    assert (event["class_uid"], event["category_uid"], event["type_uid"]) == (4001, 4, 400100)


def test_vendors_events_are_valid(spark):
    from .test_vendors import LINES

    raw = spark.createDataFrame([(k, 1_791_120_600_000, line) for k, (line, _) in LINES.items()], RAW)
    made = normalize.normalize(normalize.envelope(raw, "line", "raw_id", "recv_ms"), vendors.ALL)
    assert [r for r in made.select("source_id", validate.violations(validate.event_rules(F.col("event"))).alias("v")).collect() if r.v] == []


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []), ({"class_uid": 7}, ["class_uid"]), ({"category_uid": 1}, ["category_uid"]), ({"activity_id": 55}, ["activity_id"]), ({"type_uid": 1}, ["type_uid"]),
        ({"time": "5"}, ["time"]), ({"severity_id": 7}, ["severity_id"]), ({"src_endpoint": {"ip": "x", "port": "80"}}, ["src_endpoint.ip"]), ({"dst_endpoint": {"port": 70000}}, ["dst_endpoint.port"]), ({"lineage": {"status": "odd"}}, ["lineage.status"]),
    ],
)
def test_event_rules(spark, change, broken):
    event = {"class_uid": 4001, "category_uid": 4, "activity_id": 6, "type_uid": 400106, "time": 5, "severity_id": 1, "lineage": {"status": "parsed"}} | change
    found = one(spark, validate.violations(validate.event_rules(F.col("v"))), json.dumps(event))
    assert set(broken) <= set(found) and (found == [] or broken)


def test_ports_are_numbers(spark):
    assert [one(spark, net.port(F.col("v")), v, k) for v, k in ((80, "int"), (70000, "long"), ("80", "string"), (80.0, "double"))] == [80, None, None, None]


def test_marks_end_where_the_value_ends(spark):
    a, b = ('{"t":"2026-10-04T13:30:00Z","user":"bob"}', '{"t":"2026-10-04T13:30:00.25+02:00","disk":"full"}')
    assert one(spark, text.mask(F.col("v")), a) == '{"t":"<TS>","user":"bob"}' and one(spark, text.mask(F.col("v")), b) == '{"t":"<TS>","disk":"full"}'
    for said, want in (("00:1A:2b:3c:4d:5e up", "<MAC> up"), ("id 6ba7b810-9dad-11d1-80b4-00c04fd430c8", "id <UUID>"), ("10.0.0.1:80", "<IP>:<NUM>"), ("999.1.1.1", "<NUM>.<NUM>.<NUM>.<NUM>"), ("0x1F", "<HEX>")):
        assert one(spark, text.mask(F.col("v")), said) == want


def test_long_lines_are_cut_or_refused(spark):
    long = "é" * 40_000
    row = normalize.envelope(spark.createDataFrame([("r", 1, long)], RAW), "line", "raw_id", "recv_ms").first()
    assert row.truncated and row.line == "é" * (lake.LONGEST // 2)
    assert one(spark, extract.kv(F.col("v")), "a=1 " + "x" * 70_000 + " b=2") == {"a": "1"}
    for f, line in ((extract.json_fields, '{"a":"' + "x" * 70_000 + '"}'), (extract.xml, "<a><b>" + "x" * 70_000 + "</b></a>")):
        assert one(spark, f(F.col("v")), line) is None
    frames = lake.deframed(spark.createDataFrame([(1, bytearray(b"%d %s" % (70_000, b"x" * 70_000) + b"short\n"))], "k int, d binary"), "k", "d").orderBy("n").collect()
    assert [(len(r.data), r.truncated) for r in frames] == [(lake.LONGEST, True), (5, False)]


# ---------------------------------------------------------------- reads


def test_cursors(spark):
    for t, i in ((5, "a:0"), (1_791_120_600_000, 'quo"te\\ é'), (-1, "")):
        cursor = spark.range(1).select(reads.encode_cursor(F.lit(t), F.lit(i))).first()[0]
        assert not set(cursor) & set("+/=") and tuple(one(spark, reads.decode_cursor(F.col("v")), cursor)) == (t, i)
    for bad in ("", "x", "!!", "WzVd", None):
        assert one(spark, reads.decode_cursor(F.col("v")), bad) is None


def test_files_are_listed_without_reading(spark, tmp_path):
    lake.to_gold(spark.range(3).select(F.col("id").cast("string").alias("event_id"), F.lit(0).alias("class_uid"))).transform(lambda d: lake.write(d, str(tmp_path / "lake")) or d)
    assert lake.recent_files(spark, str(tmp_path / "lake")).count() >= 1


def test_drops_are_counted(spark):
    df = lake.to_gold(spark.createDataFrame([("a", "parsed"), ("a", "unparsed"), ("b", "unparsed")], "source_id string, status string"))
    kept, ledger = lake.without_unparsed(df)
    assert kept.count() == 1 and {(r.source_id, r.n) for r in ledger.collect()} == {("a", 1), ("b", 1)}


# ---------------------------------------------------------------- integrity


def test_missing_ends_are_found(spark):
    raw = spark.createDataFrame([("s", i, f"line {i}") for i in range(35)], "shard string, n int, data string")
    stored = integrity.frames(raw, "shard", [F.col("n")], "data", 10).cache()
    chained = integrity.chain(integrity.block_hashes(stored, "shard")).cache()
    kept = integrity.heads(chained).cache()
    bad = lambda s, c: sorted((r.block, r.hash_ok) for r in integrity.verify(s, c, "shard", "data", kept).collect() if not (r.hash_ok and r.link_ok and r.number_ok))
    assert bad(stored, chained) == []
    assert bad(stored.filter("block < 3"), chained) == [(3, False)]  # frames gone from the end
    assert bad(stored, chained.filter("block < 3")) == [(3, False)]  # a link gone from the end
    assert bad(stored.filter("block < 3"), chained.filter("block < 3")) == [(3, False)]  # both: known from the head that was kept
    summary = integrity.verify_summary(integrity.verify(stored.filter("n <> 12"), chained, "shard", "data", kept), stored).first()
    assert (summary.ok, summary.bad_shard, summary.bad_block, summary.why) == (False, "s", 1, "hash")


# ---------------------------------------------------------------- mining and forests


def test_forest_against_a_plain_walk():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(300, 3)), [[9.0, 9.0, 9.0]]])
    forest = features.Forest(points, trees=20, sample=64)

    def depth(tree, p):
        feature, cut, left, deep = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] + int(p[feature[node]] >= cut[node])
        return deep[node]

    want = [2 ** (-np.mean([depth(t, p) for t in forest.trees]) / features.c_factor(64)) for p in points]
    got = forest.score(points)
    assert got == pytest.approx(want) and got.argmax() == 300 and all(t[3].max() <= 6 + features.c_factor(64) for t in forest.trees)


def test_vendor_lines_split_over_the_cores(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert lake_queries.vendor_lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


# ---------------------------------------------------------------- medians and findings


def test_medians_of_odd_columns(spark):
    import statistics

    rng = np.random.default_rng(5)
    made = [(float(rng.normal()), float(rng.integers(0, 3)), None, 7.0 if i % 3 else float(i), None if i % 2 else float(i)) for i in range(5001)]
    columns = list("abcde")
    for n in (0, 1, 2, 3, 10, 5000, 5001):
        df = spark.createDataFrame(made[:n], "a double, b double, c double, d double, e double").repartition(3)
        got = {r.name: r.median for r in stats.medians(df, columns).collect()}
        for k, c in enumerate(columns):
            held = [r[k] for r in made[:n] if r[k] is not None]
            assert got[c] == (statistics.median(held) if held else None)


def test_findings_show_what_is_usual(spark):
    calm = [(m * 60_000 + s, f"10.0.0.{s}", f"d{m % 3}", 443, 4001, 1, 10 * s, "a", f"{m}-{s}", "{}") for m in range(40) for s in range(3)]
    scan = [(20 * 60_000 + i, "10.0.0.99", f"d{i}", i, 4001, 2, 0, "a", f"x{i}", "{}") for i in range(500)]
    gold = spark.createDataFrame(calm + scan, "t long, src_ip string, dst_ip string, dst_port int, class_uid int, action_id int, bytes_out long, source_id string, raw_ref string, event string").withColumn("time", F.timestamp_millis("t"))
    found = features.analyze(gold).collect()
    assert [r.src_ip for r in found] == ["10.0.0.99"]
    assert found[0].baselines == {"conn_count": 1.0, "uniq_dst_ip": 1.0, "uniq_dst_port": 1.0, "deny_ratio": 0.0, "bytes_out_sum": 10.0, "auth_fail_count": 0.0, "uniq_sources": 1.0}
    known = spark.createDataFrame([(found[0].event_id,)], "event_id string")
    assert features.analyze(gold, known).count() == 0 and features.analyze(gold.limit(5)).count() == 0


def test_long_documents_are_read_whole(spark):
    long = "x" * 200_000
    df = spark.createDataFrame([('{"a": "' + long + '", "b": 1}', f"<E><A>{long}</A><B>1</B></E>")], "j string, x string")
    row = df.select(extract.json_fields(F.col("j")).alias("j"), extract.xml(F.col("x")).alias("x")).first()
    assert row.j == {"a": long, "b": "1"} and row.x == {"A": long, "B": "1"}


def test_rules_read_a_document_once(spark):
    plan = spark.range(1).select(F.lit("{}").alias("v"), "id").select(validate.event_violations(F.concat("v", F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and "get_json_object" not in plan
    for said, broken in (('{"class_uid":"4001"}', ["class_uid"]), ("[]", ["class_uid"]), ("no json", ["class_uid"])):
        assert one(spark, validate.event_violations(F.col("v")), said) == broken
