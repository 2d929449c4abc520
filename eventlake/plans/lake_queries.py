"""Queries over the lake's own reads, all vendors' lines, accuracy, provenance and integrity, with their DuckDB SQL.

``events`` stands in for a lake: each row is an event of one of ten sources, and every third one was delivered twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy as scores
from ..operators import explain, extract, inference, integrity, mining, normalize, reads, rows, spans, stats, structure, validate
from ..operators.filters import Term, search
from ..session import cut, scratch, spread
from ..sources import lake, vendors
from ..streaming import headers, rate
from .catalog import IP, STATUS, _with_ip, events, query

_CLASS = "CASE event_type WHEN 'signup' THEN 3002 WHEN 'error' THEN 2004 ELSE 4001 END"
#: The lake as SQL sees it; ``copy`` tells the second delivery.
_GOLD = f"""(SELECT *, event_id || ':0' AS eid, 'raw/' || event_id || '/' || copy AS raw_ref, (epoch_us(ts) // 1000) AS time_ms, (epoch_us(ts) // 1000) + 5000 AS recv_ms,
 {_CLASS} AS class_uid, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS action_id, {STATUS} AS status, 's' || (user_id % 10) AS source_id, {IP} AS src_ip, event_id % 1000 AS dst_port, floor(value)::BIGINT AS bytes_out,
 CASE WHEN event_id % 16 = 0 THEN NULL ELSE (event_id % 16) / 16.0 END AS coverage, CASE WHEN event_id % 4 = 0 THEN '{{}}' ELSE props END AS unmapped
 FROM (SELECT *, 0 AS copy FROM events UNION ALL SELECT *, 1 FROM events WHERE event_id % 3 = 0))"""


def lake_of_events(spark, sf_dir) -> DataFrame:
    e = _with_ip(spark, sf_dir)
    both = e.withColumn("copy", F.lit(0)).unionByName(e.filter("event_id % 3 = 0").withColumn("copy", F.lit(1)))
    n = F.col("event_id")
    return lake.to_gold(
        both.select(
            F.concat(n.cast("string"), F.lit(":0")).alias("event_id"), F.concat(F.lit("raw/"), n.cast("string"), F.lit("/"), F.col("copy").cast("string")).alias("raw_ref"), F.col("ts").alias("time"), F.timestamp_millis(F.unix_millis("ts") + 5000).alias("recv_time"),
            F.when(F.col("event_type") == "signup", 3002).when(F.col("event_type") == "error", 2004).otherwise(4001).alias("class_uid"), F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("action_id"),
            F.when(F.col("event_type") == "error", "unparsed").when(F.col("event_type") == "signup", "partial").otherwise("parsed").alias("status"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source_id"), "src_ip", (n % 1000).alias("dst_port"), F.floor("value").cast("long").alias("bytes_out"),
            F.when(n % 16 != 0, (n % 16) / 16).alias("coverage"), F.when(n % 4 == 0, "{}").otherwise(F.col("props")).alias("unmapped"), F.to_json(F.struct(F.concat(F.lit("message of "), F.repeat(F.col("event_type"), 30)).alias("message"))).alias("event"),
        )
    )


_SHOWN = "eid AS event_id, raw_ref, time_ms AS time, recv_ms AS recv_time, class_uid, NULL::INT AS activity_id, action_id, status, source_id, src_ip, dst_port, bytes_out, coalesce(coverage, 0.0)::DOUBLE AS coverage"
_SOME = "event_id raw_ref time recv_time class_uid activity_id action_id status source_id src_ip dst_port bytes_out coverage".split()


@query(f"SELECT {_SHOWN} FROM {_GOLD}")
def api_rows(spark, sf_dir):
    """Rows as an interface lists them (those of the 23 columns that these events fill)."""
    return reads.api_rows(lake_of_events(spark, sf_dir)).select(*_SOME)


@query(f"SELECT eid AS event_id, raw_ref, class_uid, source_id, substr('message of ' || repeat(event_type, 30), 1, 140) AS message, coalesce(coverage, 0.0)::DOUBLE AS coverage FROM {_GOLD}")
def tail_rows(spark, sf_dir):
    return reads.tail_rows(lake_of_events(spark, sf_dir)).select("event_id", "raw_ref", "class_uid", "source_id", "message", "coverage")


@query(
    f"""WITH p AS (SELECT eid, time_ms FROM {_GOLD} ORDER BY time_ms DESC, eid DESC LIMIT 201), n AS (SELECT *, lag(eid) OVER (ORDER BY time_ms DESC, eid DESC) AS before FROM p)
 SELECT eid AS event_id, time_ms FROM n WHERE eid IS DISTINCT FROM before"""
)
def page_without_repeats(spark, sf_dir):
    """The newest page; events that were delivered twice are shown once."""
    return reads.page(lake_of_events(spark, sf_dir), 200).select("event_id", F.unix_millis("time").alias("time_ms"))


@query(f"""SELECT eid AS event_id, time_ms, rtrim(translate(base64(encode('[' || time_ms || ',"' || eid || '"]')), '+/', '-_'), '=') AS cursor FROM {_GOLD} WHERE copy = 0""")
def cursor_round_trip(spark, sf_dir):
    """A cursor for every event, read back: what comes back is what is compared."""
    made = lake_of_events(spark, sf_dir).filter("raw_ref LIKE '%/0'").select(reads.encode_cursor(F.unix_millis("time"), F.col("event_id")).alias("cursor"))
    return made.withColumn("c", reads.decode_cursor(F.col("cursor"))).select("c.event_id", "c.time_ms", "cursor")


@query(
    f"""WITH w AS (SELECT user_id AS finding, raw_ref FROM (SELECT user_id, raw_ref, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, copy DESC) AS n FROM {_GOLD}) WHERE n <= 20),
 f AS (SELECT w.finding, g.*, row_number() OVER (PARTITION BY w.finding, g.eid ORDER BY g.time_ms DESC, g.raw_ref DESC) AS n FROM w JOIN {_GOLD} g ON g.raw_ref = w.raw_ref)
 SELECT finding, eid AS event_id, raw_ref, time_ms, src_ip, status FROM f WHERE n = 1"""
)
def evidence_rows(spark, sf_dir):
    """The first 20 references of each finding (here: a user's newest rows), resolved to lake rows, each event once."""
    gold = lake_of_events(spark, sf_dir)
    number = F.split_part("raw_ref", F.lit("/"), F.lit(2)).cast("long")
    refs = gold.select("raw_ref", number.alias("event_id"), F.split_part("raw_ref", F.lit("/"), F.lit(3)).cast("int").alias("copy")).join(events(spark, sf_dir).select("event_id", F.col("user_id").alias("finding")), "event_id")
    wanted = refs.groupBy("finding").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("event_id", "copy", "raw_ref")))), lambda x: x["raw_ref"]).alias("refs"))
    return reads.rows_by_refs(gold, wanted, "finding", "refs").select("finding", "event_id", "raw_ref", F.unix_millis("time").alias("time_ms"), "src_ip", "status")


@query(
    f"""WITH n AS (SELECT * FROM {_GOLD} WHERE class_uid = 2004 AND source_id = 's3' ORDER BY time_ms DESC, eid DESC, raw_ref DESC LIMIT 200)
 SELECT eid AS event_id, raw_ref, time_ms FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY time_ms DESC, raw_ref DESC) AS i FROM n) WHERE i = 1"""
)
def recent_findings(spark, sf_dir):
    return reads.recent_findings(lake_of_events(spark, sf_dir), "s3", 500).select("event_id", "raw_ref", F.unix_millis("time").alias("time_ms"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{f.name}', '{f.dataType.simpleString()}', {f.name in reads.SUGGESTED})" for f in lake.GOLD.fields if f.name in reads.ROW_COLUMNS)
    + ") t(name, type, suggest)"
)
def field_catalog(spark, sf_dir):
    return reads.field_catalog(spark).select("name", "type", "suggest")


@query("SELECT name, levenshtein(name, 'scr_ip') AS edits FROM (SELECT unnest(['src_ip', 'dst_ip', 'event_id', 'src_port']) AS name) WHERE levenshtein(name, 'scr_ip') <= 3")
def closest_fields(spark, sf_dir):
    """Columns that a misspelt name may mean."""
    return reads.closest_fields(spark, "scr_ip", 3).filter("name IN ('src_ip', 'dst_ip', 'event_id', 'src_port')")


@query(f"SELECT source_id AS value, count(*) AS n FROM {_GOLD} WHERE lower(source_id) LIKE 's%' GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def suggested_values(spark, sf_dir):
    return reads.suggested_values(lake_of_events(spark, sf_dir), "source_id", "S", 5)


_NOW = 1_705_708_800_000


@query(
    f"""WITH t AS (SELECT source_id, count(*) AS events, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'unparsed') AS unparsed, avg(coverage::FLOAT) AS c, max(recv_ms) AS seen,
 count(*) FILTER (WHERE recv_ms // 3600000 * 3600000 BETWEEN {_NOW - 3_600_000} AND {_NOW}) / 7200.0 AS eps FROM {_GOLD} GROUP BY 1),
 k AS (SELECT source_id, field, count(*) AS n FROM (SELECT source_id, unnest(json_keys(unmapped)) AS field FROM {_GOLD} WHERE unmapped <> '{{}}') GROUP BY 1, 2),
 b AS (SELECT source_id, string_agg(field || '=' || n, ',' ORDER BY n DESC, field) AS top FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, field) AS i FROM k) WHERE i <= 10 GROUP BY 1),
 r AS (SELECT unnest(['s1', 's2', 'never seen']) AS source_id)
 SELECT coalesce(t.source_id, r.source_id) AS source_id, coalesce(events, 0) AS events, coalesce(parsed, 0) AS parsed, coalesce(partial, 0) AS partial, coalesce(unparsed, 0) AS unparsed,
 coalesce(round(parsed / events, 4), 1.0) AS parse_rate, coalesce(round(c, 4), 0.0) AS mean_coverage, seen AS last_seen_ms, coalesce(round(eps, 2), 0.0)::DOUBLE AS eps, coalesce(top, '') AS top FROM t FULL JOIN r ON t.source_id = r.source_id LEFT JOIN b ON b.source_id = t.source_id"""
)
def source_summary(spark, sf_dir):
    """All that is said of a source on one line, sources that never sent anything too."""
    registry = spark.createDataFrame([("s1",), ("s2",), ("never seen",)], "source_id string")
    made = reads.source_summary(lake_of_events(spark, sf_dir), registry, _NOW, step=3_600_000)
    top = F.coalesce(F.array_join(F.transform("top_unmapped", lambda x: F.concat_ws("=", x["field"], x["count"].cast("string"))), ","), F.lit(""))
    return made.withColumn("top", top).drop("top_unmapped")


@query(
    f"""WITH e AS (SELECT *, ['a', 'b' || (event_id % 3), 'c'] AS keys, CASE WHEN event_id % 2 = 0 THEN ['c'] ELSE ['c', 'b' || (event_id % 3)] END AS rest FROM {_GOLD}),
 f AS (SELECT source_id, field, bool_or(NOT list_contains(rest, field)) AS mapped FROM (SELECT source_id, rest, unnest(keys) AS field FROM e WHERE status <> 'unparsed') GROUP BY 1, 2),
 s AS (SELECT source_id, count(*) AS fields_seen, count(*) FILTER (WHERE mapped) AS fields_mapped FROM f GROUP BY 1),
 l AS (SELECT source_id, count(*) AS lines_total, count(*) FILTER (WHERE status <> 'unparsed') AS lines_matched, round(avg(coverage::FLOAT) FILTER (WHERE status <> 'unparsed'), 4) AS mean_event_coverage FROM e GROUP BY 1)
 SELECT l.source_id, lines_total, lines_matched, round(lines_matched / lines_total, 4) AS lines_matched_pct, fields_seen, fields_mapped, mean_event_coverage FROM l JOIN s USING (source_id)"""
)
def coverage_report(spark, sf_dir):
    n = F.split_part("event_id", F.lit(":"), F.lit(1)).cast("long")
    b = F.concat(F.lit("b"), (n % 3).cast("string"))
    e = lake_of_events(spark, sf_dir).withColumn("keys", F.array(F.lit("a"), b, F.lit("c"))).withColumn("rest", F.when(n % 2 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("c"), b)))
    return reads.coverage_report(e, "source_id", "keys", "rest", "coverage", "status")


@query("SELECT event_type AS name, sum(user_id)::BIGINT AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def ledger_prefix_sums(spark, sf_dir):
    """Counters named by a prefix: rows dropped, by reason."""
    deltas = events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("dropped:"), "event_type")).otherwise(F.concat(F.lit("sink:"), "event_type")).alias("field"), F.col("user_id").alias("n"))
    return stats.prefix_sums(deltas, "field", "n", "dropped")


@query(
    """SELECT event_type, count(*) FILTER (WHERE value <= 10) AS b0, count(*) FILTER (WHERE value > 10 AND value <= 50) AS b1, count(*) FILTER (WHERE value > 50 AND value <= 100) AS b2, count(*) FILTER (WHERE value > 100) AS b3, round(sum(value), 3) AS sum, count(*) AS n FROM events GROUP BY 1"""
)
def latency_buckets(spark, sf_dir):
    """A histogram with fixed bounds for each worker (here: type)."""
    return stats.bounded_histogram(events(spark, sf_dir), "value", (10.0, 50.0, 100.0), ["event_type"]).withColumn("sum", F.round("sum", 3))


@query(
    """WITH s AS (SELECT event_type, event_id AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 e AS (SELECT event_type, min((t, done)) FILTER (WHERE done >= floor(n * 0.1)) AS a, min((t, done)) FILTER (WHERE done >= floor(n * 0.9)) AS b FROM s GROUP BY 1)
 SELECT event_type, round((b[2] - a[2]) / (b[1] - a[1]), 9) AS rate FROM e WHERE b[1] > a[1]"""
)
def throughput_slope(spark, sf_dir):
    """Rows a unit of time between a tenth and nine tenths of each type's rows."""
    numbered = rows.running(events(spark, sf_dir).select("event_type", "event_id"), ["event_type"], [F.col("event_id")])
    return stats.throughput(numbered.select("event_type", F.col("event_id").alias("t"), (F.col("__before") + 1).alias("done")), "t", "done", ["event_type"]).withColumn("rate", F.round("rate", 9))


@query(f"SELECT coalesce(v, 'none') AS violations, count(*) AS n FROM (SELECT CASE WHEN class_uid = 2004 THEN 'finding_without_title' END AS v FROM {_GOLD}) GROUP BY 1")
def lake_validation(spark, sf_dir):
    """Lake rows against the library's own rules: findings here have no title, all else holds."""
    broken = lake_of_events(spark, sf_dir).select(validate.violations(validate.lake_rules()).alias("v"))
    return broken.groupBy(F.when(F.size("v") == 0, "none").otherwise(F.array_join("v", ",")).alias("violations")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- vendors' lines


def vendor_lines(spark, sf_dir) -> DataFrame:
    """``events`` as lines of the ten vendors in turn: event_id, recv_ms and line."""
    # Dealt before the lines are made, as events are the shorter rows.
    e = spread(_with_ip(spark, sf_dir).select("event_id", "ts", "user_id", "src_ip"))
    ms = F.unix_millis("ts")
    at = lambda f: F.date_format("ts", f)
    port, source_port = 1 + F.col("event_id") % 1000, 1024 + F.col("event_id") % 60000
    ip, user = F.col("src_ip"), F.col("user_id")
    old = F.concat(at("MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "), at("HH:mm:ss"))
    say = F.format_string
    lines = [
        say('<189>date=%s time=%s tz="+0200" devname="F1" logid="2" type="traffic" level="alert" action="deny" srcip=%s srcport=%d dstip=10.0.0.8 dstport=%d', at("yyyy-MM-dd"), at("HH:mm:ss"), ip, source_port, port),
        say("<166>%s EDGE : %%ASA-6-302013: Built outbound TCP connection 12 for outside:192.0.2.5/443 (192.0.2.5/443) to inside:%s/%d (%s/%d)", at("MMM dd yyyy HH:mm:ss"), ip, source_port, ip, source_port),
        say('{"timestamp":"%s.000000+0000","event_type":"alert","src_ip":"%s","src_port":4,"dest_ip":"10.1.2.2","dest_port":%d,"proto":"TCP","alert":{"action":"blocked","signature_id":9,"signature":"SCAN %d","severity":2},"host":"s1"}', at("yyyy-MM-dd'T'HH:mm:ss"), ip, port, user),
        say("%d.250    145 %s TCP_DENIED/403 120 CONNECT host:%d - HIER_NONE/- text/html", F.unix_seconds("ts"), ip, port),
        say("%d.5\tCabcdefghij1\t%s\t1\t10.1.1.6\t%d\tUDP\tdns\t0.25\t60\t-\tSF\t-\t-\t0\tDd\t1\t88\t1\t99\t(empty)", F.unix_seconds("ts"), ip, port),
        say('<Event xmlns="w"><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>4625</EventID><TimeCreated SystemTime="%sZ"/><Computer>DC</Computer></System><EventData><Data Name="TargetUserName">u%d</Data><Data Name="IpAddress">%s</Data></EventData></Event>', at("yyyy-MM-dd'T'HH:mm:ss"), user, ip),
        say("<30>%s gw dnsmasq[12]: query[AAAA] WWW%d.example.com from %s", old, user, ip),
        say("<134>%s L1 LEEF:2.0|Acme|Net|2|X|^|devTime=%d^devName=L1^src=%s^dst=10.1.1.6^dstPort=%d^action=DROP^sev=9", old, ms, ip, port),
        say("<134>%s C1 CEF:0|Acme|Net|2|100|Allowed|3|rt=%d src=%s spt=7 dst=10.1.1.6 dpt=%d act=allow in=14 out=31 dvchost=C1", old, ms, ip, port),
        say("<134>1 %s+00:00 pf.local filterlog 85 - - 5,,,100,igb0,match,block,in,4,0x0,,64,12,0,none,17,udp,60,%s,10.0.0.5,444,53,20", at("yyyy-MM-dd'T'HH:mm:ss"), ip),
    ]
    line = lines[-1]
    for i, x in reversed(list(enumerate(lines[:-1]))):
        line = F.when(F.col("event_id") % 10 == i, x).otherwise(line)
    return e.select("event_id", ms.alias("recv_ms"), line.alias("line"))


_NAMES = ["fortinet.fortigate", "cisco.asa", "suricata.eve", "squid.access", "zeek.conn", "windows.event_xml", "dns.dnsmasq", "leef.generic", "cef.generic_firewall", "pfsense.filterlog"]


def _each(values: list[str]) -> str:
    return "CASE v " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


_PORT, _S = "1 + event_id % 1000", "(ms // 1000) * 1000"
VENDOR_ROWS = f"""SELECT event_id || ':0' AS event_id, {_each([f"'{n}'" for n in _NAMES])} AS source_id, {_each("4001 4001 2004 4002 4001 3002 4003 4001 4001 4001".split())} AS class_uid, 'parsed' AS status,
 {_each([f"{_S} - 7200000", _S, _S, f"{_S} + 250", f"{_S} + 500", _S, _S, "ms", "ms", _S])} AS time_ms, src_ip, {_each([_PORT, "443", _PORT, "NULL", _PORT, "NULL", "NULL", _PORT, _PORT, "53"])} AS dst_port,
 {_each("2 1 2 2 NULL NULL NULL 2 1 2".split())} AS action_id, {_each(["NULL"] * 5 + ["'u' || user_id"] + ["NULL"] * 4)} AS user_name, {_each(["NULL"] * 3 + [f"'host:' || ({_PORT})"] + ["NULL"] * 6)} AS url,
 {_each(["NULL"] * 6 + ["'www' || user_id || '.example.com'"] + ["NULL"] * 3)} AS dns_query, {_each(["NULL"] * 2 + ["'SCAN ' || user_id"] + ["NULL"] * 7)} AS signature, {_each(["'F1'", "'EDGE'", "'s1'", "NULL", "NULL", "NULL", "'gw'", "'L1'", "'C1'", "'pf.local'"])} AS device_host
 FROM (SELECT *, event_id % 10 AS v, epoch_us(ts) // 1000 AS ms, {IP} AS src_ip FROM events)"""


def vendor_gold(spark, sf_dir) -> DataFrame:
    return normalize.normalize(normalize.envelope(vendor_lines(spark, sf_dir), "line", "event_id", "recv_ms"), vendors.ALL)


@query(VENDOR_ROWS)
def vendor_events(spark, sf_dir):
    """Lines of all ten vendors through detection, extraction and mapping, one of them from a device two hours east."""
    return vendor_gold(spark, sf_dir).select("event_id", "source_id", "class_uid", "status", F.unix_millis("time").alias("time_ms"), "src_ip", "dst_port", "action_id", "user_name", "url", "dns_query", "signature", "device_host")


@query(f"SELECT source_id, count(*) AS n, 0 AS invalid FROM ({VENDOR_ROWS}) GROUP BY 1")
def vendor_validity(spark, sf_dir):
    """Every vendor's events against the rules of the event schema."""
    broken = validate.event_violations(F.col("event"))
    return vendor_gold(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.size(broken) > 0).alias("invalid"))


@query(f"SELECT source_id AS part, 1.0::DOUBLE AS precision, (CASE WHEN source_id = 'squid.access' THEN 0.5 ELSE 1.0 END)::DOUBLE AS recall, (CASE WHEN source_id = 'squid.access' THEN 0.666667 ELSE 1.0 END)::DOUBLE AS f1, count(*) AS lines FROM ({VENDOR_ROWS}) GROUP BY 1")
def vendor_accuracy(spark, sf_dir):
    """Typed leaves against the truth: the address and the class are compared; a second leaf that squid lacks is asked of it."""
    gold = cut(vendor_gold(spark, sf_dir).select("source_id", "class_uid", "src_ip", "event"))
    got = F.map_filter(scores.comparable(scores.leaves(F.col("event"))), lambda k, v: k.isin("class_uid", "src_endpoint.ip") & ~((k == "class_uid") & (F.col("source_id") == "squid.access")))
    ip = F.concat(F.lit('"'), "src_ip", F.lit('"'))
    want = F.create_map(F.lit("src_endpoint.ip"), ip, F.lit("class_uid"), F.col("class_uid").cast("string"))
    pairs = gold.select("source_id", want.alias("want"), got.alias("got"))
    return scores.accuracy(pairs, "source_id", "want", "got").filter("part <> 'ALL'").drop("perfect_lines")


VECTORS = [
    ("fortigate zone", '<189>date=2026-10-04 time=13:00:00 tz="+0200" devname="F1" logid="2" type="traffic" action="deny" srcip=10.0.0.7 dstip=10.0.0.8', {"time": 1_791_111_600_000, "action_id": 2, "src_endpoint.ip": "10.0.0.7"}),
    ("squid user", "1791120600.250    145 10.1.1.5 TCP_MISS/200 120 GET http://a/ bob HIER_DIRECT/192.0.2.1 text/html", {"actor.user.name": "bob", "http_response.code": 200, "action_id": 1}),
    ("wrong on purpose", "1791120600.250    145 10.1.1.5 TCP_MISS/200 120 GET http://a/ bob HIER_DIRECT/192.0.2.1 text/html", {"http_response.code": "200", "class_uid": 4002}),
    ("of no source", "nothing that is known", {"class_uid": 4001}),
]


@query("""SELECT * FROM (VALUES ('wrong on purpose', 'http_response.code', '"200"', '200'), ('of no source', 'class_uid', '4001', NULL)) t(name, path, expected, got)""")
def golden_vectors(spark, sf_dir):
    """Vectors that sources must reproduce: only the two that are wrong on purpose fail, one of them by type alone."""
    made = spark.createDataFrame([(n, line, {k: json.dumps(v) for k, v in want.items()}) for n, line, want in VECTORS], "name string, line string, expect map<string,string>")
    return scores.vector_failures(made, vendors.ALL, 1_791_120_600_000)


@query(
    f"""SELECT event_id::VARCHAR AS raw_id, 'fortinet.fortigate' AS source_id, 'date,time,tz' AS fields, 'coalesce(from eventtime | int | epoch_ns; from date,time | concat( ) | strptime(fmt: %Y-%m-%d %H:%M:%S, tz_from: tz))' AS expression, ({_S} - 7200000)::VARCHAR AS value
 FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 10 = 0)"""
)
def time_provenance(spark, sf_dir):
    """Which fields an event's time comes from: without the device's own time, date, time and zone."""
    raw = normalize.envelope(vendor_lines(spark, sf_dir), "line", "event_id", "recv_ms")
    return explain.explain(raw, vendors.ALL).filter("path = 'time' AND source_id = 'fortinet.fortigate'").select("raw_id", "source_id", F.array_join("fields", ",").alias("fields"), "expression", "value")


@query(
    f"""WITH c AS (SELECT {_each([f"'{n}'" for n in _NAMES]).replace("CASE v", "CASE event_id % 10")} AS source_id, CASE event_id % 10 WHEN 2 THEN 'json' WHEN 5 THEN 'xml' WHEN 4 THEN 'tsv' WHEN 7 THEN 'leef' WHEN 8 THEN 'cef' WHEN 3 THEN 'text' ELSE 'syslog' END AS value FROM events)
 SELECT source_id, value, count(*) AS n, 1.0::DOUBLE AS share FROM c GROUP BY 1, 2"""
)
def format_of_source(spark, sf_dir):
    """The format that most of a source's lines are told to be."""
    from ..operators.extract import sniff

    name = F.lit(_NAMES[-1])
    for i, x in enumerate(_NAMES[:-1]):
        name = F.when(F.col("event_id") % 10 == i, x).otherwise(name)
    return mining.majority(vendor_lines(spark, sf_dir).withColumn("source_id", name), sniff(F.col("line")), "source_id")


# ---------------------------------------------------------------- integrity


@query("SELECT user_id AS segment, count(*) AS frames, (count(*) + 99) // 100 AS blocks, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def segment_listing(spark, sf_dir):
    stored = integrity.frames(events(spark, sf_dir).select("user_id", "event_id", "props"), "user_id", [F.col("event_id")], "props", 100)
    return integrity.segments(stored, "user_id", "props")


@query("SELECT FALSE AS ok, (SELECT sum(b)::BIGINT FROM (SELECT (count(*) + 9) // 10 AS b FROM events GROUP BY user_id)) AS blocks_checked, (SELECT count(*) FROM events) - 1 AS frames_checked, min(user_id) AS bad_shard, 0 AS bad_block, 'hash' AS why FROM events")
def verify_summary(spark, sf_dir):
    """One frame of the first shard is missing: its first block is the first failure."""
    kept = cut(integrity.frames(events(spark, sf_dir).select("user_id", "event_id", "props"), "user_id", [F.col("event_id")], "props", 10))
    chained = cut(integrity.chain(integrity.block_hashes(kept, "user_id")))
    first = kept.agg(F.min(F.struct("user_id", "event_id")).alias("m")).select("m.*")
    left = kept.join(F.broadcast(first), ["user_id", "event_id"], "left_anti")
    return integrity.verify_summary(integrity.verify(left, chained, "user_id", "props", integrity.heads(chained)), left)


@query(
    """WITH a AS (SELECT event_id AS x, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS y, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_type = 'view')
 SELECT i, x, y FROM a FULL JOIN b USING (i)"""
)
def positional_zip(spark, sf_dir):
    """Truth line i beside event i."""
    e = events(spark, sf_dir)
    both = rows.zipped(e.filter("event_type = 'click'").select("event_id"), e.filter("event_type = 'view'").select("event_id"), "event_id")
    return both.select("i", F.col("a.event_id").alias("x"), F.col("b.event_id").alias("y"))


@query(f"SELECT eid AS event_id, src_ip FROM {_GOLD} WHERE raw_ref IN ('raw/3/0', 'raw/3/1', 'raw/17/0') AND NOT coalesce(src_ip LIKE '10.0.%', FALSE)")
def rows_of_refs_without(spark, sf_dir):
    """Rows by reference, without those of one network."""
    return search(lake_of_events(spark, sf_dir), [Term("raw_ref", ("raw/3/0", "raw/3/1", "raw/17/0")), Term("src_ip", ("10.0.*",), negate=True)]).select("event_id", "src_ip")


def incidents(spark, sf_dir) -> DataFrame:
    """A port scan, a series of failed logons and an exfiltration, one after another, as lake rows."""
    n = F.col("id")
    scan = spark.range(1500).select((n * 40).alias("t"), F.lit("203.0.113.9").alias("src_ip"), F.lit("10.1.2.15").alias("dst_ip"), (n + 1).alias("dst_port"), F.lit(4001).alias("class_uid"), F.lit(2).alias("action_id"), F.lit(0).cast("long").alias("bytes_out"), F.lit(0).alias("status_id"))
    logons = spark.range(600).select((60_000 + n * 100).alias("t"), F.lit("203.0.113.77").alias("src_ip"), F.lit("10.1.2.22").alias("dst_ip"), F.lit(22).cast("long").alias("dst_port"), F.lit(3002).alias("class_uid"), F.lit(0).alias("action_id"), F.lit(0).cast("long").alias("bytes_out"), F.lit(2).alias("status_id"))
    sent = spark.range(40).select((120_000 + n * 1500).alias("t"), F.lit("10.1.3.30").alias("src_ip"), F.lit("198.51.100.5").alias("dst_ip"), F.lit(443).cast("long").alias("dst_port"), F.lit(4001).alias("class_uid"), F.lit(1).alias("action_id"), F.lit(15_000_000).cast("long").alias("bytes_out"), F.lit(0).alias("status_id"))
    made = scan.unionByName(logons).unionByName(sent)
    return made.select(F.timestamp_millis(F.col("t") + 1_791_120_600_000).alias("time"), "src_ip", "dst_ip", "dst_port", "class_uid", "action_id", "bytes_out", F.to_json(F.struct("status_id")).alias("event"), F.concat_ws("-", "src_ip", F.col("t").cast("string")).alias("raw_ref"), F.lit("gen").alias("source_id"))


@query(
    """SELECT * REPLACE (deny_ratio::DOUBLE AS deny_ratio) FROM (VALUES ('203.0.113.9', 0, 1500, 1, 1500, 0.997340425532, 0, 0), ('203.0.113.77', 60000, 0, 1, 1, 0.0, 0, 600), ('10.1.3.30', 120000, 40, 1, 1, 0.0, 600000000, 0)) t(src, began, conn_count, uniq_dst_ip, uniq_dst_port, deny_ratio, bytes_out_sum, auth_fail_count)"""
)
def incident_features(spark, sf_dir):
    """Three kinds of incident as the features of their minute."""
    from ..operators import features

    made = features.windows(features.project(lake.to_gold(incidents(spark, sf_dir))), evidence=0)
    return made.select("src", (F.col("window_start") - 1_791_120_600_000).alias("began"), "conn_count", "uniq_dst_ip", "uniq_dst_port", F.round("deny_ratio", 12).alias("deny_ratio"), "bytes_out_sum", "auth_fail_count")


@query("SELECT line, ok FROM (SELECT props AS line, TRUE AS ok FROM events UNION ALL SELECT 'broken ' || props, FALSE FROM events WHERE event_id % 5 = 0)")
def json_lines_checked(spark, sf_dir):
    """Event documents a line; lines that are no JSON are kept and marked."""
    e = events(spark, sf_dir)
    lines = e.select(F.col("props").alias("line")).unionByName(e.filter("event_id % 5 = 0").select(F.concat(F.lit("broken "), "props").alias("line")))
    return lake.checked_json(lines, "line").select("line", "ok")


# ---------------------------------------------------------------- what is known of unknown sources

_MIXED = {
    "at_s": "(epoch_us(ts) // 1000000)::VARCHAR", "at_ms": "(epoch_us(ts) // 1000)::VARCHAR", "nanos": "(epoch_us(ts) // 1000)::VARCHAR || '000000'", "count_s": "(epoch_us(ts) // 1000000)::VARCHAR", "seconds": "(epoch_us(ts) // 1000000)::VARCHAR",
    "ts_float": "(epoch_us(ts) // 1000000)::VARCHAR || '.5'", "src_ip": IP, "peer": "CASE WHEN event_id % 50 = 0 THEN 'fe80::' || (event_id % 9) WHEN event_id % 30 = 1 THEN 'none' ELSE " + IP + " END",
    "hw": "printf('00:1b:%02x:00:00:%02x', event_id % 256, user_id % 256)", "dport": "(event_id % 65536)::VARCHAR", "bytes": "(event_id * 100000)::VARCHAR", "ratio": "(event_id % 7)::VARCHAR || '.' || (event_id % 10)", "ok": "CASE WHEN event_id % 3 = 0 THEN 'True' ELSE 'no' END",
    "link": "CASE WHEN event_id % 11 = 0 THEN '-' ELSE 'https://h' || user_id || '/x' END", "kind": "event_type", "note": "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE event_type || event_id END", "day": "strftime(ts, '%Y-%m-%d')", "clock": "strftime(ts, '%H:%M:%S')", "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'",
}
_TESTS_SQL = {
    "ip": r"regexp_matches(value, '^[0-9]+(\.[0-9]+){3}$') OR value LIKE 'fe80::%'", "mac": r"regexp_matches(value, '^([0-9a-f]{2}:){5}[0-9a-f]{2}$')", "iso8601": "value LIKE '____-__-__T%'", "date": r"regexp_matches(value, '^\d{4}-\d\d-\d\d$')", "time": r"regexp_matches(value, '^\d\d:\d\d:\d\d$')",
    "int": r"regexp_matches(value, '^-?\d+$')", "float": r"regexp_matches(value, '^-?\d+(\.\d+)?$')", "bool": "lower(value) IN ('true', 'false', 'yes', 'no')", "url": "value LIKE 'https://%'",
}


def _range(low: int, name: str = "") -> str:
    return f"low >= {low} AND high < {4 * low}" + (f" AND regexp_matches(name, '{name}')" if name else "")


@query(
    f"""WITH v AS ({" UNION ALL ".join(f"SELECT event_id, '{n}' AS name, {e} AS value FROM events" for n, e in _MIXED.items())}), c AS (SELECT name, value, count(*) AS n, min(event_id) AS first FROM v WHERE value <> '' GROUP BY 1, 2),
 e AS (SELECT name, sum(n)::BIGINT AS seen, count(*) AS distinct_values, min(try_cast(value AS DECIMAL(38,9))) AS low, max(try_cast(value AS DECIMAL(38,9))) AS high, {", ".join(f'coalesce(sum(n) FILTER ({t}), 0) / sum(n) >= {0.9 if k == "url" else 0.95} AS is_{k}' for k, t in _TESTS_SQL.items())} FROM c GROUP BY 1),
 x AS (SELECT name, list(value ORDER BY first, value)[:5] AS examples FROM c GROUP BY 1),
 t AS (SELECT *, CASE WHEN is_ip THEN 'ip' WHEN is_mac THEN 'mac' WHEN is_iso8601 THEN 'timestamp iso8601' WHEN is_date THEN 'timestamp date' WHEN is_time THEN 'timestamp time' WHEN is_int AND {_range(10**9, "time|ts|stamp|date|epoch|created|start|end")} THEN 'timestamp epoch_s'
  WHEN is_int AND {_range(10**12)} THEN 'timestamp epoch_ms' WHEN is_int AND {_range(10**18)} THEN 'timestamp epoch_ns' WHEN is_int AND name LIKE '%port%' AND low >= 0 AND high < 65536 THEN 'port' WHEN is_int THEN 'int' WHEN is_float AND {_range(10**9, "time|ts|stamp|date|epoch")} THEN 'timestamp epoch_s' WHEN is_float THEN 'float' WHEN is_bool THEN 'bool' WHEN is_url THEN 'url'
  WHEN distinct_values <= 12 AND (seen < 20 OR distinct_values <= seen * 0.25) THEN 'enum' ELSE 'text' END AS said FROM e)
 SELECT t.name, split_part(said, ' ', 1) AS type, nullif(split_part(said, ' ', 2), '') AS unit, round(seen / (SELECT count(*) FROM events), 6) AS support, seen, distinct_values AS "distinct", array_to_string(examples, '|') AS examples FROM t JOIN x ON t.name = x.name"""
)
def field_inference(spark, sf_dir):
    """All types and units of fields made from the events, with support and the values that came first."""
    e = _with_ip(spark, sf_dir)
    n, us, text = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp")), lambda c: c.cast("string")
    s, ms = text(F.floor(us / 1_000_000)), text(F.floor(us / 1000))
    values = {
        "at_s": s, "at_ms": ms, "nanos": F.concat(ms, F.lit("000000")), "count_s": s, "seconds": s, "ts_float": F.concat(s, F.lit(".5")), "src_ip": F.col("src_ip"), "peer": F.when(n % 50 == 0, F.concat(F.lit("fe80::"), text(n % 9))).when(n % 30 == 1, "none").otherwise(F.col("src_ip")),
        "hw": F.format_string("00:1b:%02x:00:00:%02x", n % 256, F.col("user_id") % 256), "dport": text(n % 65536), "bytes": text(n * 100000), "ratio": F.concat(text(n % 7), F.lit("."), text(n % 10)), "ok": F.when(n % 3 == 0, "True").otherwise("no"), "link": F.when(n % 11 == 0, "-").otherwise(F.concat(F.lit("https://h"), text(F.col("user_id")), F.lit("/x"))),
        "kind": F.col("event_type"), "note": F.when(n % 4 == 0, "").when(n % 4 == 1, F.lit(None)).otherwise(F.concat("event_type", text(n))), "day": F.date_format("ts", "yyyy-MM-dd"), "clock": F.date_format("ts", "HH:mm:ss"), "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    fields = e.select("event_id", F.explode(F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])).alias("name", "value"))
    found = inference.infer_types(inference.value_counts(fields, "event_id"), e.count())
    return found.withColumn("examples", F.array_join("examples", "|"))


#: A field of each vendor's lines, what stands before its value, and the value.
_SPOTS = [
    (0, "date", "date=", "strftime(ts, '%Y-%m-%d')"), (0, "srcip", "srcip=", IP), (0, "dstport", "dstport=", "1 + event_id % 1000"), (1, "dip", "inside:", IP), (1, "ts", "<166>", "strftime(ts, '%b %d %Y %H:%M:%S')"), (2, "src_ip", '"src_ip":"', IP), (2, "dest_port", '"dest_port":', "1 + event_id % 1000"), (2, "alert.signature", '"signature":"', "'SCAN ' || user_id"),
    (3, "client", "145 ", IP), (3, "url", "CONNECT ", "'host:' || (1 + event_id % 1000)"), (4, "ts", "", "(epoch_us(ts) // 1000000) || '.5'"), (4, "id.orig_h", "Cabcdefghij1\t", IP), (5, "EventData.TargetUserName", '"TargetUserName">', "'u' || user_id"), (5, "EventData.IpAddress", '"IpAddress">', IP), (5, "System.TimeCreated.@SystemTime", 'SystemTime="', "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'"),
    (6, "name", "query[AAAA] ", "'WWW' || user_id || '.example.com'"), (6, "client", "com from ", IP), (7, "devTime", "devTime=", "epoch_us(ts) // 1000"), (7, "src", "^src=", IP), (7, "dstPort", "dstPort=", "1 + event_id % 1000"), (8, "rt", "rt=", "epoch_us(ts) // 1000"), (8, "src", " src=", IP), (8, "dpt", "dpt=", "1 + event_id % 1000"), (9, "src", ",udp,60,", IP),
]
_OLD = "strftime(ts, '%b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S')"
_LINE = f"""CASE event_id % 10 WHEN 0 THEN printf('<189>date=%s time=%s tz="+0200" devname="F1" logid="2" type="traffic" level="alert" action="deny" srcip=%s srcport=%d dstip=10.0.0.8 dstport=%d', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M:%S'), {IP}, 1024 + event_id % 60000, 1 + event_id % 1000)
 WHEN 1 THEN printf('<166>%s EDGE : %%ASA-6-302013: Built outbound TCP connection 12 for outside:192.0.2.5/443 (192.0.2.5/443) to inside:%s/%d (%s/%d)', strftime(ts, '%b %d %Y %H:%M:%S'), {IP}, 1024 + event_id % 60000, {IP}, 1024 + event_id % 60000)
 WHEN 2 THEN printf('{{"timestamp":"%s.000000+0000","event_type":"alert","src_ip":"%s","src_port":4,"dest_ip":"10.1.2.2","dest_port":%d,"proto":"TCP","alert":{{"action":"blocked","signature_id":9,"signature":"SCAN %d","severity":2}},"host":"s1"}}', strftime(ts, '%Y-%m-%dT%H:%M:%S'), {IP}, 1 + event_id % 1000, user_id)
 WHEN 3 THEN printf('%d.250    145 %s TCP_DENIED/403 120 CONNECT host:%d - HIER_NONE/- text/html', epoch_us(ts) // 1000000, {IP}, 1 + event_id % 1000)
 WHEN 4 THEN (epoch_us(ts) // 1000000) || '.5' || chr(9) || 'Cabcdefghij1' || chr(9) || {IP} || chr(9)
 WHEN 5 THEN printf('<Event xmlns="w"><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>4625</EventID><TimeCreated SystemTime="%sZ"/><Computer>DC</Computer></System><EventData><Data Name="TargetUserName">u%d</Data><Data Name="IpAddress">%s</Data></EventData></Event>', strftime(ts, '%Y-%m-%dT%H:%M:%S'), user_id, {IP})
 WHEN 6 THEN printf('<30>%s gw dnsmasq[12]: query[AAAA] WWW%d.example.com from %s', {_OLD}, user_id, {IP}) WHEN 7 THEN printf('<134>%s L1 LEEF:2.0|Acme|Net|2|X|^|devTime=%d^devName=L1^src=%s^dst=10.1.1.6^dstPort=%d^action=DROP^sev=9', {_OLD}, epoch_us(ts) // 1000, {IP}, 1 + event_id % 1000)
 WHEN 8 THEN printf('<134>%s C1 CEF:0|Acme|Net|2|100|Allowed|3|rt=%d src=%s spt=7 dst=10.1.1.6 dpt=%d act=allow in=14 out=31 dvchost=C1', {_OLD}, epoch_us(ts) // 1000, {IP}, 1 + event_id % 1000)
 ELSE printf('<134>1 %s+00:00 pf.local filterlog 85 - - 5,,,100,igb0,match,block,in,4,0x0,,64,12,0,none,17,udp,60,%s,10.0.0.5,444,53,20', strftime(ts, '%Y-%m-%dT%H:%M:%S'), {IP}) END"""


@query(
    f"""WITH l AS (SELECT *, {_LINE} AS line FROM events), w AS ({" UNION ALL ".join(f"SELECT event_id, line, '{_NAMES[v]}' AS source_id, '{f}' AS field, replace('{p}', '~', chr(9)) AS prefix, ({e})::VARCHAR AS value FROM l WHERE event_id % 10 = {v}".replace(chr(92) + "t", "~") for v, f, p, e in _SPOTS)}),
 s AS (SELECT *, instr(line, prefix || value) - 1 + length(prefix) AS place FROM w)
 SELECT event_id, source_id, field, value, place AS start, place + length(value) AS "end", place AS byte_start, place + length(value) AS byte_end, true AS exact, value AS said FROM s"""
)
def field_spans(spark, sf_dir):
    """Where the values of all vendors' lines stand, of those fields that SQL can tell by what is before them."""
    raw = normalize.envelope(vendor_lines(spark, sf_dir), "line", "event_id", "recv_ms")
    found = spans.field_spans(raw, vendors.ALL)
    shown = [f"{_NAMES[v]}|{f}" for v, f, _, _ in _SPOTS]
    said = F.substring(F.col("line"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.filter(F.concat_ws("|", "source_id", "field").isin(shown)).select(F.col("raw_id").cast("long").alias("event_id"), "source_id", "field", "value", "start", "end", "byte_start", "byte_end", "exact", said.alias("said"))


_TABBED = """SELECT *, CASE WHEN event_id % 40 = 0 THEN CASE (event_id // 40) % 3 WHEN 0 THEN '#fields' || chr(9) || 'who' || chr(9) || 'kind' || chr(9) || 'sum' WHEN 1 THEN '#fields' || chr(9) || 'kind' || chr(9) || 'who' ELSE '#unset_field' || chr(9) || 'view' END
 ELSE event_type || chr(9) || user_id || chr(9) || floor(value)::BIGINT END AS line, 's' || (event_id % 7) AS source FROM events"""


@query(
    f"""WITH l AS ({_TABBED}), h AS (SELECT *, last_value(CASE WHEN line LIKE '#fields%' THEN line END IGNORE NULLS) OVER w AS header, coalesce(last_value(CASE WHEN line LIKE '#unset%' THEN split_part(line, chr(9), 2) END IGNORE NULLS) OVER w, '-') AS unset FROM l WINDOW w AS (PARTITION BY source ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT *, CASE WHEN line LIKE '#%' THEN NULL WHEN header IS NULL THEN NULL ELSE list_position(string_split(header, chr(9))[2:], 'who') END AS who, CASE WHEN line LIKE '#%' THEN NULL WHEN header IS NULL THEN NULL ELSE list_position(string_split(header, chr(9))[2:], 'kind') END AS kind, string_split(line, chr(9)) AS cells FROM h)
 SELECT event_id, line LIKE '#%' AS control, nullif(cells[who], unset) AS who, nullif(cells[kind], unset) AS kind, CASE WHEN NOT line LIKE '#%' AND len(string_split(header, chr(9))) = 3 THEN nullif(cells[3], unset) END AS extra FROM c"""
)
def headed_lines(spark, sf_dir):
    """Tab-separated lines of seven sources, read by the header that holds for each; control lines stay."""
    e = events(spark, sf_dir)
    n, tab = F.col("event_id"), lambda *c: F.concat_ws("\t", *c)
    header = F.when(F.floor(n / 40) % 3 == 0, tab(*map(F.lit, ("#fields", "who", "kind", "sum")))).when(F.floor(n / 40) % 3 == 1, tab(*map(F.lit, ("#fields", "kind", "who")))).otherwise(tab(F.lit("#unset_field"), F.lit("view")))
    line = F.when(n % 40 == 0, header).otherwise(tab(F.col("event_type"), F.col("user_id").cast("string"), F.floor("value").cast("string")))
    lines = e.select("event_id", line.alias("line"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("source"))
    made = headers.with_header(lines, "source", "event_id").withColumn("f", extract.tsv_with_header(F.col("line"), F.col("header")))
    shown = lambda name: F.when(F.col("header.fields").isNotNull(), F.col("f")[name])
    return made.select("event_id", "control", shown("who").alias("who"), shown("kind").alias("kind"), shown("_extra").alias("extra"))


@query(
    """WITH l AS (SELECT event_id, CASE WHEN event_id % 20 = 0 THEN ', NAT <IP>:<NUM>' WHEN event_id % 20 = 1 THEN ', <WORD> <IP>' ELSE '' END AS clause FROM events)
 SELECT 'fw <WORD> in:<WORD>, proto <WORD>, <IP>:<NUM>-><IP>:<NUM>' || clause || ' len <NUM>' AS skeleton, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS share, min(event_id) AS first_key FROM l GROUP BY clause"""
)
def structure_groups(spark, sf_dir):
    """Shapes of a firewall's lines: words all share are structure, so is the keyword of a rare clause; two that take turns are not."""
    n, text = F.col("event_id"), lambda c: c.cast("string")
    clause = F.when(n % 20 == 0, ", NAT 10.0.0.1:7").when(n % 40 == 1, ", VIA 10.0.0.2").when(n % 20 == 1, ", MAP 10.0.0.2").otherwise("")
    line = F.concat(F.lit("fw "), "event_type", F.lit(" in:eth"), text(F.col("user_id") % 3), F.lit(", proto "), F.when(n % 3 == 0, "TCP").otherwise("UDP"), F.lit(", 10.0.0."), text(n % 250), F.lit(":80->192.0.2.1:"), text(n % 1000), clause, F.lit(" len "), text(n % 1400))
    e = spread(events(spark, sf_dir).select("event_id", "event_type", "user_id"))
    found = structure.groups(e.select("event_id", line.alias("line")), "line", "event_id")
    return found.select("skeleton", "n", F.round("share", 6).alias("share"), "first_key")


_DAY = 86_400_000


@query(
    f"""WITH RECURSIVE d AS (SELECT event_type, (epoch_us(ts) // 1000) // {_DAY} * {_DAY} AS "at", count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY "at") AS i FROM events GROUP BY 1, 2),
 b AS (SELECT event_type, "at", n, i, least(n, 30) AS taken, (30 - least(n, 30)) * {_DAY}::BIGINT AS held FROM d WHERE i = 1
 UNION ALL SELECT d.event_type, d."at", d.n, d.i, least(d.n, least(30 * {_DAY}::BIGINT, b.held + (d."at" - b."at") * 20) // {_DAY}), least(30 * {_DAY}::BIGINT, b.held + (d."at" - b."at") * 20) - least(d.n, least(30 * {_DAY}::BIGINT, b.held + (d."at" - b."at") * 20) // {_DAY}) * {_DAY} FROM b JOIN d ON d.event_type = b.event_type AND d.i = b.i + 1),
 p AS (SELECT event_type, "at", unnest(range(taken)) * n // taken AS r FROM b WHERE taken > 0),
 e AS (SELECT *, row_number() OVER (PARTITION BY event_type, "at" ORDER BY event_id) - 1 AS r FROM (SELECT event_id, event_type, (epoch_us(ts) // 1000) // {_DAY} * {_DAY} AS "at" FROM events))
 SELECT e.event_id, e.event_type, e."at" FROM e JOIN p USING (event_type, "at", r)"""
)
def rate_capped(spark, sf_dir):
    """Each type's events, twenty a day by a bucket that holds thirty, at equal distances where a day has more."""
    e = events(spark, sf_dir).select("event_id", "event_type", F.expr(f"unix_millis(ts) div {_DAY} * {_DAY}").alias("at"))
    counts = e.groupBy("event_type", "at").agg(F.count("*").alias("n"))
    return rate.let_through(e, ["event_type", "at"], [F.col("event_id")], rate.allowed_over(counts, "event_type", rate.Cap(20, _DAY, 30)))


@query(f"SELECT class_uid, CASE WHEN class_uid = 3002 THEN count(*) ELSE count(DISTINCT eid) END AS n, count(DISTINCT eid) AS events FROM {_GOLD} GROUP BY 1")
def incremental_compaction(spark, sf_dir):
    """A lake written in five pieces is compacted in place, so each event stays once; what was written since is left as it is."""
    gold = lake_of_events(spark, sf_dir).withColumn("time", F.timestamp_millis(F.lit(1_704_067_200_000)))
    with scratch(spark, "lake") as path:
        for k in range(5):
            lake.write(gold.filter((F.col("class_uid") != 3002) & (F.pmod(F.crc32("raw_ref"), F.lit(5)) == k)), path)
        last = lake.recent_files(spark, path, 1).select(F.unix_millis("changed")).first()
        lake.write(gold.filter("class_uid = 3002"), path)
        if last is not None:
            lake.compact_settled(spark, path, settle_ms=0, now_ms=last[0])
        found = spark.read.schema(lake.partitioned(gold).schema).parquet(path)
        return cut(found.groupBy("class_uid").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events")))


#: What is put in place of a right value, and the rules that it breaks, by event_id modulo their number.
_BREAKS = [
    (None, ""), ("class_uid", "class_uid"), ("category_uid", "category_uid"), ("activity_id", "activity_id"), ("type_uid", "type_uid"), ("time", "time"), ("lineage", "lineage,lineage.status"), ("status", "lineage.status"),
    ("title", "finding_info.title"), ("action_id", "action_id"), ("severity_id", "severity_id"), ("ip", "src_endpoint.ip"), ("port", "dst_endpoint.port"), ("quoted", "category_uid"),
]


@query("SELECT event_id, " + "CASE event_id % " + str(len(_BREAKS)) + "".join(f" WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_BREAKS)) + " END AS violations FROM events")
def broken_events(spark, sf_dir):
    """Event documents of which each breaks one rule of the schema, or none; a rule says which by its path."""
    n = F.col("event_id")
    case = lambda what: n % len(_BREAKS) == [b for b, _ in _BREAKS].index(what)
    finding = case("title")
    num = lambda right, what, wrong: F.when(case(what), wrong).otherwise(right)
    cls = F.when(finding, 2004).otherwise(4001)
    category = F.when(case("quoted"), F.lit('"4"')).otherwise(num(F.when(finding, 2).otherwise(4), "category_uid", 3).cast("string"))
    lineage = F.when(case("lineage"), F.lit("")).otherwise(F.concat(F.lit(',"lineage":{"status":"'), F.when(case("status"), "broken").otherwise("parsed"), F.lit('"}')))
    parts = [
        F.lit('{"class_uid":'), num(cls, "class_uid", 7).cast("string"), F.lit(',"category_uid":'), category, F.lit(',"activity_id":'), num(F.when(finding, 1).otherwise(6), "activity_id", 44).cast("string"),
        F.lit(',"type_uid":'), num(cls * 100 + F.when(finding, 1).otherwise(6), "type_uid", 400107).cast("string"), F.lit(',"time":'), F.when(case("time"), F.lit('"noon"')).otherwise(F.unix_millis("ts").cast("string")),
        F.lit(',"action_id":'), num(F.lit(1), "action_id", 17).cast("string"), F.lit(',"severity_id":'), num(F.lit(4), "severity_id", 8).cast("string"), F.lit(',"src_endpoint":{"ip":"'), F.when(case("ip"), F.lit("10.0.0.256")).otherwise(F.lit("10.0.0.7")),
        F.lit('"},"dst_endpoint":{"port":'), num((n % 65536).cast("int"), "port", 65536).cast("string"), F.lit("}"), lineage, F.lit("}"),
    ]
    made = spread(events(spark, sf_dir).select("event_id", "ts")).select("event_id", F.concat(*parts).alias("event"))
    return made.select("event_id", F.array_join(validate.event_violations(F.col("event")), ",").alias("violations"))


@query(
    f"""WITH w AS (SELECT event_id || ':0' AS event_id, {IP} AS ip, 1 + event_id % 1000 AS port FROM events), c AS (SELECT source_id, coalesce(src_ip = ip, false)::INT + coalesce(dst_port = port, false)::INT AS tp, (src_ip IS NOT NULL)::INT + (dst_port IS NOT NULL)::INT AS made FROM ({VENDOR_ROWS}) JOIN w USING (event_id)),
 s AS (SELECT source_id, sum(tp) / nullif(sum(made), 0) AS p, sum(tp) / (2 * count(*)) AS r, count(*) AS lines, count(*) FILTER (WHERE tp = 2 AND made = 2) AS perfect FROM c GROUP BY 1)
 SELECT source_id AS part, round(coalesce(p, 1), 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(coalesce(2 * coalesce(p, 1) * r / nullif(coalesce(p, 1) + r, 0), 0), 6)::DOUBLE AS f1, lines, perfect AS perfect_lines FROM s"""
)
def vendor_truth(spark, sf_dir):
    """Sources' events against the events that their lines were made from: the address and the port that each line was given."""
    truth = _with_ip(spark, sf_dir).select(F.concat(F.col("event_id").cast("string"), F.lit(":0")).alias("__id"), F.create_map(F.lit("src_endpoint.ip"), F.concat(F.lit('"'), "src_ip", F.lit('"')), F.lit("dst_endpoint.port"), (1 + F.col("event_id") % 1000).cast("string")).alias("want"))
    gold = cut(vendor_gold(spark, sf_dir).select("event_id", "source_id", "event"))
    got = F.map_filter(scores.comparable(scores.leaves(F.col("event"))), lambda k, v: k.isin("src_endpoint.ip", "dst_endpoint.port"))
    pairs = gold.join(truth, gold["event_id"] == truth["__id"]).select("source_id", "want", got.alias("got"))
    return scores.accuracy(pairs, "source_id", "want", "got").filter("part <> 'ALL'")
