"""Spans of values, types of fields and paths for them, against plain versions and known mappings."""

import os
import re

import pytest
from pyspark.sql import functions as F

from eventlake.operators import inference, normalize, spans
from eventlake.operators.mapping import Source, references
from eventlake.plans import lake_queries
from eventlake.sources import vendors

FOLDER = "/root/testdata/sf0.001"


def source(kind, options=None, framing="none", match="."):
    return Source("s", [("regex", match)], kind, options or {}, otherwise="base_event", classes={"base_event": {"message": {"const": 1}}}, framing=framing)


def traced(spark, lines, *args, **kw):
    df = spark.createDataFrame([(str(i), i, x) for i, x in enumerate(lines)], "key string, ms long, line string")
    rows = spans.field_spans(normalize.envelope(df, "line", "key", "ms"), [source(*args, **kw)]).collect()
    found = {}
    for r in rows:
        raw = r.line.encode()[r.byte_start : r.byte_end].decode()
        assert raw == r.line[r.start : r.end]
        found.setdefault(r.raw_id, {})[r.field] = (r.value, raw, r.exact)
    return found


CASES = {
    "kv": ([r'é=1 a="x \"y\" ü" b=2 a=3 c="open', "漢=字 k="], {}),
    "csv": (['é,"a,b",,x', 'p,"say \\"hi\\"",q,r,s,t'], {"columns": ["c1", "c2", "c3", "c4"]}),
    "tsv": (["é\t-\t(empty)\tü\tmore\tand"], {"fields": ["a", "b", "c", "d"]}),
    "cef": ([r"é CEF:0|Ve\|n|P|1|2|Nä me|5|msg=a b\=c\nd ext.x=ü  last=z"], {}),
    "leef": (["x LEEF:1.0|V|P|1|E|a=é b\tc=d=e\tnone", "LEEF:2.0|V|P|1|E|x5E|a=ü^b=2"], {}),
    "json": ['{"é": {"a": "ü\\n", "l": [1, "x"], "t": true, "z": null}, "e": {}, "n": -1.50, "é2" : "漢"}', ' {"a":1,"a":2}'],
    "xml": ['<E xmlns="u" id="é"><S><T at="ü &amp; v">x</T><V>  two  </V></S><D><Data Name="N">a&lt;b</Data><Data>z</Data><Data>later</Data></D></E>'],
    "regex": (["né 10 up", "né 11 "], {"pattern": r"^(?P<who>\S+) (?P<n>\d+) (?P<state>\w*)$"}),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_spans_hold_their_values(spark, kind):
    lines, options = CASES[kind] if isinstance(CASES[kind], tuple) else (CASES[kind], {})
    got = traced(spark, lines, kind, options)
    assert len(got) == len(lines) and all(exact for fields in got.values() for _, _, exact in fields.values())
    plain = [v == raw for fields in got.values() for v, raw, _ in fields.values()]
    assert any(plain) and (all(plain) or kind in ("kv", "csv", "cef", "json", "xml"))
    for fields in got.values():  # what differs from its text is escaped there
        assert all(v == raw or "\\" in raw or "&" in raw or kind == "json" for v, raw, _ in fields.values())


def test_spans_of_framed_and_unread_lines(spark):
    got = traced(spark, ["<13>1 2024-01-01T00:00:00Z hé app 1 2 - ü a=ö", "plain a=b", "no pairs"], "kv", framing="syslog")
    assert got["0"]["a"][:2] == ("ö", "ö") and got["1"]["a"] == ("b", "b", True) and "2" not in got
    df = spark.createDataFrame([("1", 0, None)], "key string, ms long, line string")
    assert spans.field_spans(normalize.envelope(df, "line", "key", "ms"), [source("kv")]).count() == 0


def test_values_that_the_scanner_tells_otherwise_are_not_exact():
    assert spans.scan("a,b", "json", {}) == [] and spans.scan("<a><b></a>", "xml", {}) == [] and spans.scan('{"a": ', "json", {}) == []
    assert spans.locate("ab xx ab", {"k": "ab", "l": "xx", "m": "ab", "n": "zz", "o": ""}) == [("k", "ab", 0, 2), ("l", "xx", 3, 5), ("m", "ab", 6, 8)]
    assert spans.byte_places("aé漢\U0001f600", [0, 1, 2, 3, 4]) == [0, 1, 3, 6, 10]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_every_span_of_every_vendor(spark):
    raw = normalize.envelope(lake_queries.vendor_lines(spark, FOLDER), "line", "event_id", "recv_ms")
    found = spans.field_spans(raw, vendors.ALL)
    said = F.substring(F.col("line"), F.col("start") + 1, F.col("end") - F.col("start"))
    row = found.agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if(said == F.col("value")).alias("same"), F.count_distinct("raw_id").alias("lines")).first()
    assert row.n == row.exact == row.same > 10_000 and row.lines == 1000


# ---------------------------------------------------------------- types


def types_of(spark, values, rows=None):
    data = [(name, v, i) for name, mine in values.items() for i, v in enumerate(mine)]
    df = spark.createDataFrame(data, "name string, value string, i long")
    return {r.name: r for r in inference.infer_types(inference.value_counts(df, "i"), rows).collect()}


def test_types_and_units(spark):
    many = lambda x, n=38: [x] * n
    got = types_of(
        spark,
        {
            "ip": [*many("10.0.0.1"), "fe80::1", "not one"], "ip_few": [*many("10.0.0.1", 9), "no"], "m": ["00:11:22:33:44:55", "AA-bb-cc-dd-ee-ff"], "start": ["1700000000", "3999999999"], "x": ["1700000000"], "y": ["1700000000000"], "z": ["1700000000000000000"], "late": ["4000000000000"],
            "s_port": ["0", "65535"], "port": ["65536"], "p": ["80"], "i": ["-5", "7"], "f": ["1.5", "2"], "ts": ["1700000000.5"], "b": ["TRUE", "no"], "u": [*many("https://x/y", 9), "none"], "e": many("a", 30) + many("b", 10), "t": [f"v{i}" for i in range(40)], "few": ["a", "b", "a"],
            "d": ["2024-01-01"], "dt": ["2024-01-01 01:02:03"], "sy": ["Jan  1 01:02:03"], "syy": ["Jan 1 2024 01:02:03"], "iso": ["2024-01-01T01:02:03.5+0200"], "c": ["01:02:03"], "gone": [None, ""], "digits": ["9" * 60],
        },
        rows=40,
    )
    want = {
        "ip": "ip", "ip_few": "enum", "m": "mac", "start": ("timestamp", "epoch_s"), "x": "int", "y": ("timestamp", "epoch_ms"), "z": ("timestamp", "epoch_ns"), "late": "int", "s_port": "port", "port": "int", "p": "port", "i": "int", "f": "float", "ts": ("timestamp", "epoch_s"), "b": "bool", "u": "url", "e": "enum", "t": "text", "few": "enum",
        "d": ("timestamp", "date"), "dt": ("timestamp", "datetime"), "sy": ("timestamp", "syslog_ts"), "syy": ("timestamp", "syslog_ts_year"), "iso": ("timestamp", "iso8601"), "c": ("timestamp", "time"), "digits": "int",
    }
    assert {n: (r.type, r.unit) for n, r in got.items()} == {n: t if isinstance(t, tuple) else (t, None) for n, t in want.items()}
    assert (got["ip"].support, got["ip"].seen, got["ip"].distinct, list(got["ip"].examples)) == (1.0, 40, 3, ["10.0.0.1", "fe80::1", "not one"])
    assert list(got["t"].examples) == [f"v{i}" for i in range(5)]
    assert types_of(spark, {"a": [None]}) == {}


# ---------------------------------------------------------------- paths


def greedy(scores, least=0.5):
    """One pair after another."""
    names, paths, out = set(), set(), set()
    for score, path, name in sorted(((-s, p, n) for n, p, s in scores if s >= least)):
        if name not in names and path not in paths:
            names.add(name)
            paths.add(path)
            out.add((name, path, -score))
    return out


def test_assignment_against_a_plain_one(spark):
    import random

    rng = random.Random(2)
    for size in (1, 6, 25):
        made = {(f"n{rng.randrange(size)}", f"p{rng.randrange(size)}"): rng.choice([0.2, 0.5, 0.9, 1.0]) for _ in range(size * 4)}
        df = spark.createDataFrame([(n, p, s) for (n, p), s in made.items()], "name string, path string, score double")
        assert {tuple(r) for r in inference.suggest(df).collect()} == greedy([(n, p, s) for (n, p), s in made.items()])
    assert inference.suggest(df.limit(0)).count() == 0


def test_scores(spark):
    known = spark.createDataFrame([("a.ip", "srcip", ["ip"]), ("a.port", "spt", ["port"]), ("a.what", "act", [])], "path string, alias string, types array<string>")
    fields = spark.createDataFrame([("src-IP", "ip"), ("SRCIP2", "text"), ("spt", "int"), ("act", "enum"), ("12", "int")], "name string, type string")
    counts = spark.createDataFrame([("src-IP", "10.0.0.1", 1, 0), ("SRCIP2", "x", 1, 0), ("spt", "5", 1, 0), ("act", " N/A", 99, 0), ("act", "deny", 1, 0)], "name string, value string, n long, first long")
    got = {(r.name, r.path): round(r.score, 6) for r in inference.path_scores(fields, known, counts).collect()}
    assert got == {("src-IP", "a.ip"): 1.0, ("SRCIP2", "a.ip"): 0.27, ("spt", "a.port"): 1.0, ("act", "a.what"): 0.2}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_known_mapping_of_vendors_left_out(spark):
    """Each vendor's mapping is guessed from what the others call the paths: what is found must be right."""
    raw = normalize.envelope(lake_queries.vendor_lines(spark, FOLDER), "line", "event_id", "recv_ms")
    found = normalize.detect(raw, vendors.ALL).filter("kind IS NOT NULL")
    fields = found.select(F.col("raw_id").cast("long").alias("i"), F.split_part("kind", F.lit("|"), F.lit(1)).alias("source"), F.explode("fields").alias("field", "value"))
    fields = fields.filter(~F.col("field").startswith("syslog.") & ~F.col("field").contains("\x00"))
    counts = inference.value_counts(fields.withColumn("name", F.concat_ws("|", "source", "field")), "i").cache()
    types = inference.infer_types(counts).cache()
    right = wrong = 0
    for left_out in (vendors.CEF, vendors.LEEF, vendors.FORTIGATE, vendors.PFSENSE):
        names = [(p, f) for s in vendors.ALL if s is not left_out for p, f in inference.aliases([s])]
        mine = lambda df: df.filter(F.col("name").startswith(f"{left_out.id}|")).withColumn("name", F.split_part("name", F.lit("|"), F.lit(2)))  # noqa: E731, B023
        others = types.filter(~F.col("name").startswith(f"{left_out.id}|")).select(F.split_part("name", F.lit("|"), F.lit(2)).alias("name"), "type")
        known = inference.known_paths(spark.createDataFrame(names, "path string, field string"), others)
        truth = {(f, p) for p, f in inference.aliases([left_out])}
        got = {(r.name, r.path) for r in inference.suggest(inference.path_scores(mine(types), known, mine(counts))).collect()}
        addresses = {(f, p) for f, p in truth if re.fullmatch(r"(src|dst)_endpoint\.(ip|port)", p)}
        told = {plain for _, plain in ((p, re.sub("[^0-9a-z]", "", f.lower())) for p, f in names)}
        assert {(f, p) for f, p in addresses if re.sub("[^0-9a-z]", "", f.lower()) in told and f in {r.name for r in mine(types).collect()}} <= got
        right += len(got & truth)
        wrong += len({(f, p) for f, p in got if f in {x for x, _ in truth}} - truth)
    assert right >= 15 and wrong <= right / 4


def test_aliases_name_every_field():
    pairs = inference.aliases(vendors.ALL)
    assert ("src_endpoint.ip", "srcip") in pairs and all(any(f in references(e) for s in vendors.ALL for c in s.classes.values() for q, e in c.items() if q == p) for p, f in pairs)
