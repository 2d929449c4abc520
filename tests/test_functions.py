import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.functions import net, text, time
from eventlake.functions.pipes import apply, to_int
from eventlake.operators import extract
from eventlake.operators.filters import Term, millis_of, predicate, search
from eventlake.sources.lake import split_frames


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "expect"),
    [
        (lambda: net.ip(F.col("v")), "10.1.2.3", "10.1.2.3"), (lambda: net.ip(F.col("v")), "010.1.2.3", None), (lambda: net.ip(F.col("v")), "2001:DB8:0:0::1", "2001:db8::1"), (lambda: net.ip(F.col("v")), "x:y", None),
        (lambda: net.mac(F.col("v")), "00-1A-2b-3c-4D-5e", "00:1a:2b:3c:4d:5e"), (lambda: net.mac(F.col("v")), "00-1A", None), (lambda: to_int(F.col("v")), " 12 ", 12), (lambda: to_int(F.col("v")), "1.5", None), (lambda: to_int(F.col("v")), "9" * 30, None),
        (lambda: time.hms(F.col("v")), "1:02:03", 3_723_000), (lambda: time.hms(F.col("v")), "1:62:03", None), (lambda: time.iso8601(F.col("v")), "2026-10-04T13:30:00.1239Z", 1_791_120_600_123), (lambda: time.iso8601(F.col("v")), "2026-10-04 13:30:00+0530", 1_791_100_800_000), (lambda: time.iso8601(F.col("v")), "2026", None), (lambda: time.iso8601(F.col("v")), "2026-13-04T13:30:00Z", None),
        (lambda: time.strptime(F.col("v"), "%b %d %Y %H:%M:%S"), "Oct  4 2026 13:30:00", 1_791_120_600_000), (lambda: time.strptime(F.col("v"), "%Y-%m-%d %H:%M:%S", "Asia/Kolkata"), "2026-10-04 19:00:00", 1_791_120_600_000), (lambda: time.strptime(F.col("v"), "%Y-%m-%d"), "2026-02-30", None), (lambda: time.strptime(F.col("v"), "%H:%M:%S"), "10:00:61", None),
        (lambda: time.epoch(F.col("v"), "s"), "1.0005", 1000), (lambda: time.epoch(F.col("v"), "ns"), "-1", -1), (lambda: time.epoch(F.col("v"), "ms"), "x", None),
        (lambda: apply(F.col("v"), [("split", {"sep": "|", "index": -1})]), "a|b", "b"), (lambda: apply(F.col("v"), [("split", {"sep": "|", "index": 5})]), "a|b", None), (lambda: apply(F.col("v"), [("regex", {"pattern": "(?P<q>b+)", "group": "q"})]), "abbc", "bb"), (lambda: apply(F.col("v"), ["int", "port"]), "70000", None), (lambda: apply(F.col("v"), ["int", "proto_name"]), "6", "tcp"),
        (lambda: text.mask(F.col("v")), "from 10.0.0.1 id 17 at 0xff", "from <IP> id <NUM> at <HEX>"), (lambda: text.strip(F.col("v")), "  a \n", "a"), (lambda: text.slug(F.col("v")), "Src IP!", "src_ip"),
    ],
)
def test_values(spark, column, value, expect):
    assert one(spark, column(), v=value) == expect


def test_null_stays_null(spark):
    for column in (net.ip(F.col("v")), net.mac(F.col("v")), time.iso8601(F.col("v")), time.hms(F.col("v")), to_int(F.col("v")), extract.kv(F.col("v")), extract.cef(F.col("v")), extract.json_fields(F.col("v"))):
        assert one(spark, column, v=None) is None


def test_buckets_round_down(spark):
    assert one(spark, time.bucket(F.col("v"), 1000), v=-7) == -1000


def test_uuid7_keeps_its_time(spark):
    made = one(spark, time.uuid7(F.col("v"), F.lit("seed")), v=1_791_120_600_123)
    assert made[14] == "7" and made[19] in "89ab"
    assert one(spark, time.uuid7_millis(F.col("v")), v=made) == 1_791_120_600_123


@pytest.mark.parametrize(
    ("column", "line", "expect"),
    [
        (lambda: extract.kv(F.col("v")), 'a=1 b="x y" c= a=2 bare d="un', {"a": "1", "b": "x y", "c": "", "a_2": "2", "d": "un"}),
        (lambda: extract.kv(F.col("v")), "nothing here", None),
        (lambda: extract.regex(F.col("v"), r"(?P<a>\d+)(?:-(?P<b>\w*))?$"), "12", {"a": "12"}),
        (lambda: extract.dispatch(F.col("v"), r"%(?P<id>\d): (?P<body>.*)$", "id", "body", {"1": r"got (?P<n>\d+)"}), "%1: got 5", {"id": "1", "body": "got 5", "n": "5"}),
        (lambda: extract.csv(F.col("v"), ["a", "b"]), '1,"x,y",z,w', {"a": "1", "b": "x,y", "_extra": "z,w"}),
        (lambda: extract.csv(F.col("v"), ["a", "k"], branch={"field": "k", "cases": {"X": {"columns": ["p"]}}, "default": {"columns": ["q"]}}), "1,x,2,3", {"a": "1", "k": "x", "p": "2", "_extra": "3"}),
        (lambda: extract.csv(F.col("v"), ["a", "k"], branch={"field": "k", "cases": {"X": {"columns": ["p"]}}, "default": {"columns": ["q"]}}), "1,y,2", {"a": "1", "k": "y", "q": "2"}),
        (lambda: extract.cef(F.col("v")), "CEF:0|V\\|x|P|1|7|n|3|src=1.1.1.1 msg=a b\\=c", {"cef.version": "0", "cef.vendor": "V|x", "cef.product": "P", "cef.device_version": "1", "cef.signature_id": "7", "cef.name": "n", "cef.severity": "3", "src": "1.1.1.1", "msg": "a b=c"}),
        (lambda: extract.leef(F.col("v")), "LEEF:1.0|V|P|1|E|a=1\tb=2", {"leef.version": "1.0", "leef.vendor": "V", "leef.product": "P", "leef.product_version": "1", "leef.event_id": "E", "a": "1", "b": "2"}),
        (lambda: extract.tsv(F.col("v"), ["a", "b"]), "1\t-\t3", {"a": "1", "_extra": "3"}),
        (lambda: extract.json_fields(F.col("v")), '{"a":{"b":1},"c":[1,"x"],"d":{},"e":null}', {"a.b": "1", "c": '[1,"x"]'}),
        (lambda: extract.json_fields(F.col("v")), "[1]", None),
        (lambda: extract.xml(F.col("v")), '<E><S><I k="1">4</I></S><D><Data Name="U">x</Data></D></E>', {"S.I": "4", "S.I.@k": "1", "D.U": "x"}),
        (lambda: extract.xml(F.col("v")), "<!DOCTYPE a><a/>", None),
    ],
)
def test_extractors(spark, column, line, expect):
    assert one(spark, column(), v=line) == expect


def test_syslog_year_of_the_past(spark):
    received = int(dt.datetime(2026, 1, 1, 0, 5, tzinfo=dt.timezone.utc).timestamp() * 1000)
    found = one(spark, extract.syslog(F.col("v"), F.lit(received)), v="<13>Dec 31 23:59:00 box said so")
    assert (found.message, found.host, found.priority, found.assumed) == ("said so", "box", 13, True)
    assert found.time_ms == int(dt.datetime(2025, 12, 31, 23, 59, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_sniff(spark):
    lines = {'{"a":1}': "json", "<a/>": "xml", "<1>CEF:0|a": "cef", "<34>x": "syslog", "a\tb": "tsv", "plain": "text"}
    assert {k: one(spark, extract.sniff(F.col("v")), v=k) for k in lines} == lines


def test_terms(spark):
    df = spark.createDataFrame([("10.1.0.1", "TCP", 5), ("10.2.0.1", "udp", None), (None, None, 7)], "src_ip string, proto_name string, n int")
    found = lambda *t: [r[0] for r in search(df, list(t)).collect()]
    assert found(Term("src_ip", ("10.1.0.0/16",))) == ["10.1.0.1"]
    assert found(Term("proto_name", ("tcp",))) == ["10.1.0.1"]
    assert found(Term("n", (5,), negate=True)) == ["10.2.0.1", None]
    assert found(Term("src_ip", ("10.*.0.1",))) == ["10.1.0.1", "10.2.0.1"]
    assert found(Term("n", ((5, 6),), "..")) == ["10.1.0.1"]
    with pytest.raises(ValueError):
        predicate(Term("n", ()), df.schema)
    with pytest.raises(ValueError):
        search(df, [Term("src_ip", ("fe80::/10",))])
    assert millis_of("2024-01-02") == 1_704_153_600_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).filter(lambda b: not b.endswith(b"\r"))))
def test_counted_frames_come_back(messages):
    assert split_frames(b"".join(b"%d %s" % (len(m), m) for m in messages)) == messages


def test_line_frames():
    assert split_frames(b"one\r\ntwo\n\n9999 short\nlast") == [b"one", b"two", b"9999 short", b"last"]


def test_patterns_are_matched_once(spark):
    from eventlake.sources import vendors

    line = spark.range(1).select(F.concat(F.lit("<166>"), F.col("id").cast("string")).alias("v"))
    for source, most in ((vendors.ASA, 200), (vendors.DNSMASQ, 60)):
        plan = line.select(extract.EXTRACTORS[source.kind](F.col("v"), **source.options))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract(") + plan.count("regexp_replace(") + plan.count("RLIKE") < most
    said = spark.createDataFrame([("a\x00b=1",), ("ab=2",), ("none",)], "v string").select(extract.regex(F.col("v"), r"(?P<k>[^=]+)=(?P<n>\d)(?P<no>x)?").alias("f")).collect()
    assert [r.f for r in said] == [{"k": "a\x00b", "n": "1"}, {"k": "ab", "n": "2"}, None]


def test_spread_deals_by_rows(spark, tmp_path):
    from eventlake.session import spread

    spark.range(250_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 5
