"""Every query of the library that runs on the driver's tables, with its DuckDB SQL.

Roles of the tables: ``events.event_type`` stands for status or source, ``user_id`` for the source address, ``props`` for
unmapped JSON, ``documents.text`` for raw lines. Every query reads whole tables; limits are parts of top-k and page features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net, text, time
from ..functions.pipes import OPS, apply, lookup
from ..operators import extract, features, filters, integrity, mining, normalize, rows, stats
from ..operators.filters import Term
from ..operators.mapping import Source
from ..session import cut, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ts as a timestamp of UTC."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# ---------------------------------------------------------------- search

#: CRC-32 in SQL: the table of the 256 bytes' remainders, and its use on a list of bytes.
CRC_TABLE = "(SELECT list(t ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i)))"


def crc32_sql(byte_list: str) -> str:
    """CRC-32 of a list of bytes, where ``crc`` of :data:`CRC_TABLE` is in scope."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte_list}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


NEWEST = "SELECT event_id, event_type, user_id, (epoch_us(ts) // 1000) AS ts_ms FROM events {where} ORDER BY ts DESC, event_id DESC LIMIT 101"


def _page(df: DataFrame) -> DataFrame:
    return df.select("event_id", "event_type", "user_id", F.unix_millis("ts").alias("ts_ms"))


@query(NEWEST.format(where=""))
def search_page(spark, sf_dir):
    """The newest page of 100 and one row more."""
    return _page(filters.page(events(spark, sf_dir), 100, time="ts"))


@query(NEWEST.format(where="WHERE ts < TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND event_id < 500)"))
def keyset_next_page(spark, sf_dir):
    """The page after a cursor."""
    return _page(filters.page(events(spark, sf_dir), 100, ("2024-01-15 12:00:00", 500), time="ts"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2, 3)")
def terms_equality_list(spark, sf_dir):
    df = filters.search(read(spark, sf_dir, "lineitem"), [Term("l_returnflag", ("A", "R")), Term("l_linenumber", (1, 2, 3))])
    return df.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND (l_discount >= 0.05 OR l_discount >= 0.09)")
def terms_range_and_compare(spark, sf_dir):
    df = filters.search(read(spark, sf_dir, "lineitem"), [Term("l_quantity", ((10, 20),), ".."), Term("l_discount", (0.05, 0.09), ">=")])
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status_or_null FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', FALSE)")
def terms_negation_keeps_null(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status_or_null"))
    return filters.search(df, [Term("status_or_null", ("F",), negate=True)])


@query(r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' ESCAPE '\' AND NOT coalesce(p_brand LIKE 'Brand#1%' ESCAPE '\', FALSE)")
def terms_wildcard(spark, sf_dir):
    return filters.search(read(spark, sf_dir, "part"), [Term("p_name", ("*a*e*",)), Term("p_brand", ("Brand#1*",), negate=True)]).select("p_partkey", "p_name")


@query("SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%the ing%'")
def free_text(spark, sf_dir):
    return filters.search(read(spark, sf_dir, "documents"), [Term("text", ("the ing",), "text")]).select("doc_id", "n_chars")


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-07 12:30:00'")
def time_bounds(spark, sf_dir):
    df = filters.time_bounds(events(spark, sf_dir), "2024-01-05", "2024-01-07T12:30:00Z", "ts")
    return df.select("event_id", F.unix_millis("ts").alias("ts_ms"))


IP = "concat('10.', user_id % 256, '.', event_id % 256, '.', (event_id * 7) % 256)"


def _with_ip(spark, sf_dir) -> DataFrame:
    octets = [F.lit("10"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), ((F.col("event_id") * 7) % 256).cast("string")]
    return events(spark, sf_dir).withColumn("src_ip", F.concat_ws(".", *octets))


@query(f"SELECT event_id, src_ip FROM (SELECT event_id, user_id, {IP} AS src_ip FROM events) WHERE user_id % 256 BETWEEN 0 AND 7 AND event_id % 256 < 256")
def cidr_match(spark, sf_dir):
    return filters.search(_with_ip(spark, sf_dir), [Term("src_ip", ("10.0.0.0/13",))]).select("event_id", "src_ip")


# ---------------------------------------------------------------- facets, histograms, source statistics


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE lower(p_brand) LIKE 'brand%' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def facet_values(spark, sf_dir):
    return stats.facet(read(spark, sf_dir, "part"), "p_brand", "Brand", 10)


TYPES = ["click", "error", "purchase", "signup", "view"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES)


@query(f"SELECT ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS bucket_ms, {_COUNTS} FROM events GROUP BY 1")
def time_histogram(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir), "ts", "event_type", TYPES, 86_400_000)


@query(
    f"""WITH b AS (SELECT ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS bucket_ms, {_COUNTS} FROM events WHERE event_type <> 'view' GROUP BY 1),
 c AS (SELECT unnest(generate_series(min(bucket_ms), max(bucket_ms), 3600000)) AS bucket_ms FROM b)
 SELECT c.bucket_ms, {", ".join(f"coalesce(b.{t}, 0) AS {t}" for t in TYPES)} FROM c LEFT JOIN b USING (bucket_ms)"""
)
def histogram_zero_fill(spark, sf_dir):
    counts = stats.histogram(events(spark, sf_dir).filter("event_type <> 'view'"), "ts", "event_type", TYPES, 3_600_000)
    return stats.zero_filled(counts, "bucket_ms", 3_600_000, TYPES)


STATUS = "CASE WHEN event_type = 'error' THEN 'unparsed' WHEN event_type = 'signup' THEN 'partial' ELSE 'parsed' END"


def _statuses(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "unparsed").when(F.col("event_type") == "signup", "partial").otherwise("parsed")
    return events(spark, sf_dir).select("*", status.alias("status"), (F.col("event_id") % 16 / 16).alias("coverage"), F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"))


_BASE = f"(SELECT *, {STATUS} AS status, (event_id % 16) / 16 AS coverage, 's' || (user_id % 10) AS source FROM events)"


@query(
    f"""SELECT source AS source_id, count(*) AS events, count(*) FILTER (WHERE status = 'parsed') AS parsed, count(*) FILTER (WHERE status = 'partial') AS partial,
 count(*) FILTER (WHERE status = 'unparsed') AS unparsed, round(avg(coverage), 6) AS mean_coverage, max((epoch_us(ts) // 1000)) AS last_seen_ms FROM {_BASE} GROUP BY 1"""
)
def source_totals(spark, sf_dir):
    return stats.source_totals(_statuses(spark, sf_dir), "source", "status", "coverage", "ts").withColumn("mean_coverage", F.round("mean_coverage", 6))


@query(
    f"""SELECT source AS source_id, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS bucket_ms, count(*) AS n, count(*) / 3600.0::DOUBLE AS eps,
 round(count(*) FILTER (WHERE status = 'parsed') / count(*), 4) AS parse_rate, round(sum(coverage) / count(*), 4) AS coverage FROM {_BASE} GROUP BY 1, 2"""
)
def source_series(spark, sf_dir):
    return stats.source_series(_statuses(spark, sf_dir), "source", "status", "coverage", "ts", 3_600_000)


@query(
    f"""WITH b AS (SELECT source, (status = 'parsed')::INT AS ok, coverage AS c, (epoch_us(ts) // 1000) >= 1705708800000 AS new FROM {_BASE}),
 a AS (SELECT source AS source_id, count(*) FILTER (WHERE new) AS recent, avg(ok) AS rate, avg(c) AS covered, avg(ok) FILTER (WHERE new) AS nr, avg(c) FILTER (WHERE new) AS nc FROM b GROUP BY 1)
 SELECT source_id, recent, recent >= 50 AND nr < rate - 0.05 AS parse_rate_fell, recent >= 50 AND nc < covered - 0.08 AS coverage_fell FROM a"""
)
def drift_flags(spark, sf_dir):
    return stats.drift(_statuses(spark, sf_dir), "source", "status", "coverage", "ts", 1_705_708_800_000)


@query(
    """WITH r AS (SELECT * FROM events WHERE props IS NOT NULL AND props <> '{}' ORDER BY ts DESC, event_id DESC LIMIT 3000),
 p AS (SELECT ts, event_id, unnest(json_keys(props)) AS name, props FROM r)
 SELECT name, count(*) AS n, substr(max_by(json_extract_string(props, '$.' || name), (ts, event_id)), 1, 120) AS example FROM p GROUP BY 1 ORDER BY n DESC, name LIMIT 200"""
)
def unmapped_key_counts(spark, sf_dir):
    return stats.unmapped_keys(events(spark, sf_dir), "props", "ts", "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events")
def json_path_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).select("event_id", k.alias("k"), k.try_cast("long").alias("k_number"))


@query(
    """WITH r AS (SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20000)
 SELECT user_id AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 20"""
)
def peers_of_newest(spark, sf_dir):
    newest = filters.page(events(spark, sf_dir).filter("event_type = 'click'"), 19_999, time="ts")
    return stats.facet(newest, "user_id", most=20)


LEDGER = ["click", "purchase", "view"]


@query(
    """SELECT source_id, click, purchase, view, click - purchase - view AS in_flight, click = purchase + view AS conserved FROM (
 SELECT user_id AS source_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1)"""
)
def ledger_totals(spark, sf_dir):
    deltas = events(spark, sf_dir).select("user_id", "event_type", F.lit(1).cast("long").alias("n"))
    return stats.ledger_totals(deltas, "user_id", "event_type", "n", LEDGER)


@query(
    """WITH b AS (SELECT d.lang AS g, l.quality = 1 AS t, d.n_chars > 500 AS f FROM labels l JOIN documents d USING (doc_id)),
 s AS (SELECT CASE WHEN grouping(g) = 1 THEN 'ALL' ELSE g END AS part, count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE NOT t AND f) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn FROM b GROUP BY ROLLUP (g)),
 q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM s)
 SELECT part, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM q"""
)
def precision_recall(spark, sf_dir):
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return stats.precision_recall(both, F.col("quality") == 1, F.col("n_chars") > 500, "lang")


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT max(v) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95, max(v) FILTER (WHERE i = least(floor(n * 0.99), n - 1)) AS p99 FROM s")
def nearest_rank_percentiles(spark, sf_dir):
    return stats.nearest_rank(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99])


# ---------------------------------------------------------------- rows: dedupe, sets, joins, order

_TWICE = "(SELECT event_id, event_type, value, 0 AS copy FROM events UNION ALL SELECT event_id, event_type, value + 1, 1 FROM events WHERE event_id % 3 = 0)"


def _redelivered(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "event_type", "value")
    return e.withColumn("copy", F.lit(0)).unionByName(e.filter("event_id % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("copy", F.lit(1)))


@query(f"SELECT event_id, event_type, value, copy FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY copy) AS n FROM {_TWICE}) WHERE n = 1")
def first_by_key(spark, sf_dir):
    return rows.first_by_key(_redelivered(spark, sf_dir), "event_id", [F.col("copy").asc()])


@query(f"SELECT event_id, event_type, value, copy FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY copy DESC) AS n FROM {_TWICE}) WHERE n = 1")
def newest_by_key(spark, sf_dir):
    return rows.newest_by_key(_redelivered(spark, sf_dir), "event_id", "copy", "value").select("event_id", "event_type", "value", "copy")


@query(f"SELECT event_type, count(*) AS delivered, count(DISTINCT event_id) AS events FROM {_TWICE} GROUP BY 1")
def count_distinct_redelivery(spark, sf_dir):
    return _redelivered(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("delivered"), F.count_distinct("event_id").alias("events"))


@query(
    """WITH u AS (SELECT o_orderkey, o_totalprice, o_orderstatus, 0 AS part FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, o_totalprice, NULL, 1 FROM orders WHERE o_orderkey % 3 = 0)
 SELECT o_orderkey, o_totalprice, o_orderstatus, part FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY part) AS n FROM u) WHERE n = 1"""
)
def compaction(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    even = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("part"))
    third = o.filter("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice", F.lit(1).alias("part"))
    return rows.compact([even, third], "o_orderkey", [F.col("part").asc()])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_join_new(spark, sf_dir):
    known = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.not_yet(read(spark, sf_dir, "customer"), known, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey WHERE n <= 3 AND o_orderpriority = '1-URGENT'")
def evidence_lookup(spark, sf_dir):
    """The first references of each finding, resolved to their rows."""
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = read(spark, sf_dir, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines.withColumn("n", n).filter("n <= 3").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT a.doc_id, b.first_id, a.sha FROM (SELECT doc_id, sha256(text) AS sha FROM documents) a JOIN (SELECT sha256(text) AS sha, min(doc_id) AS first_id FROM documents GROUP BY 1) b USING (sha)")
def truth_join_sha(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.join(d.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "sha").select("doc_id", "first_id", "sha")


@query("SELECT coalesce(a.n_nationkey, b.s_nationkey) AS nation, coalesce(n_name, 'unknown') AS n_name, coalesce(suppliers, 0) AS suppliers FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.n_nationkey = b.s_nationkey")
def full_outer_registry(spark, sf_dir):
    registry = read(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), "n_name")
    seen = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return rows.outer_registry(seen, registry, "nation", {"n_name": "unknown", "suppliers": 0}).select("nation", "n_name", "suppliers")


@query("SELECT source, lang FROM documents EXCEPT ALL SELECT source, lang FROM documents WHERE n_chars > 1000")
def multiset_difference(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return rows.multiset_difference(d.select("source", "lang"), d.filter("n_chars > 1000").select("source", "lang"))


@query(f"SELECT p AS partition, count(*) AS n FROM (SELECT {crc32_sql("list_transform(string_split(user_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 16 AS p FROM events, {CRC_TABLE}) GROUP BY 1")
def hash_partition(spark, sf_dir):
    """Rows of each of 16 partitions by crc32 of the source."""
    return events(spark, sf_dir).groupBy(rows.partition_of(F.col("user_id").cast("string"), 16).alias("partition")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- value operations


@query(
    """SELECT p_partkey, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_number, p_size * 1000 AS size_ms, lower(p_type) AS type_lower, upper(p_brand) AS brand_upper,
 nullif(regexp_extract(p_name, '([a-z]+)', 1), '') AS first_word, string_split(p_type, ' ')[1] AS type_first, string_split(p_type, ' ')[-1] AS type_last,
 CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS size_name FROM part"""
)
def pipe_ops(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    brand = apply(F.col("p_brand"), [("regex", {"pattern": r"(?P<n>\d+)", "group": "n"}), "int"])
    first, last = (apply(F.col("p_type"), [("split", {"sep": " ", "index": i})]) for i in (0, -1))
    return p.select("p_partkey", brand.alias("brand_number"), apply(F.col("p_size"), [("mul", 1000)]).alias("size_ms"), OPS["lower"]("p_type").alias("type_lower"), OPS["upper"]("p_brand").alias("brand_upper"), apply(F.col("p_name"), [("regex", {"pattern": "([a-z]+)"})]).alias("first_word"), first.alias("type_first"), last.alias("type_last"), lookup(F.col("p_size"), {1: "one", 2: "two"}, "many").alias("size_name"))


@query(
    """SELECT event_id, CASE event_id % 20 WHEN 1 THEN 'icmp' WHEN 2 THEN 'igmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END AS proto,
 CASE WHEN event_id % 100000 <= 65535 THEN event_id % 100000 END AS port, ((event_id % 30) * 3600 + (event_id % 60) * 60 + (event_id % 60)) * 1000 AS hms_ms FROM events"""
)
def pipe_ops_network(spark, sf_dir):
    clock = F.format_string("%d:%02d:%02d", F.col("event_id") % 30, F.col("event_id") % 60, F.col("event_id") % 60)
    return events(spark, sf_dir).select("event_id", apply(F.col("event_id") % 20, ["proto_name"]).alias("proto"), net.port(F.col("event_id") % 100000).cast("long").alias("port"), time.hms(clock).alias("hms_ms"))


@query(
    """SELECT event_id, epoch_ms(date_trunc('second', ts)) AS iso_ms, epoch_ms(date_trunc('second', ts)) - 19800000 AS offset_ms, epoch_ms(date_trunc('second', ts)) AS strptime_ms,
 ((epoch_us(ts) // 1000) // 1000) * 1000 AS epoch_s_ms FROM events"""
)
def times_to_millis(spark, sf_dir):
    e = events(spark, sf_dir)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.date_format("ts", "MMM d yyyy HH:mm:ss")
    return e.select("event_id", time.iso8601(F.concat(iso, F.lit("Z"))).alias("iso_ms"), time.iso8601(F.concat(iso, F.lit("+0530"))).alias("offset_ms"), time.strptime(said, "%b %d %Y %H:%M:%S").alias("strptime_ms"), time.epoch(F.unix_seconds("ts").cast("string"), "s").alias("epoch_s_ms"))


# ---------------------------------------------------------------- lines: extraction, mapping, normalisation

FIREWALL = Source(
    id="example.firewall",
    match=[("contains", "devname="), ("contains", "logid=")],
    kind="kv",
    framing="syslog",
    select=[("type", "traffic", "network_activity"), ("type", "utm", "detection_finding")],
    classes={
        "network_activity": {
            "activity_id": {"const": 6},
            "time": {"from": "eventtime", "pipe": ["int", "epoch_ns"]},
            "severity_id": {"from": "level", "pipe": [("lookup", {"map": {"notice": 1, "warning": 2, "error": 3}, "default": 0})]},
            "action_id": {"from": "action", "pipe": [("lookup", {"map": {"accept": 1, "deny": 2}, "default": 0})]},
            "src_endpoint.ip": {"from": "srcip", "pipe": ["ipv4"]},
            "src_endpoint.port": {"from": "srcport", "pipe": ["int", "port"]},
            "dst_endpoint.ip": {"from": "dstip", "pipe": ["ipv4"]},
            "dst_endpoint.port": {"from": "dstport", "pipe": ["int", "port"]},
            "connection_info.protocol_num": {"from": "proto", "pipe": ["int"]},
            "connection_info.protocol_name": {"from": "proto", "pipe": ["int", "proto_name"]},
            "traffic.bytes_out": {"from": "sentbyte", "pipe": ["int"]},
            "duration": {"from": "duration", "pipe": ["int", ("mul", 1000)]},
            "device.hostname": "devname",
        },
        "detection_finding": {
            "activity_id": {"const": 1},
            "time": {"from": "eventtime", "pipe": ["int", "epoch_ns"]},
            "finding_info.title": {"coalesce": ["attack", "msg", "subtype"]},
            "src_endpoint.ip": {"from": "srcip", "pipe": ["ipv4"]},
            "device.hostname": "devname",
        },
        "base_event": {"time": {"from": "eventtime", "pipe": ["int", "epoch_ns"]}, "device.hostname": "devname"},
    },
    ignore={"devid": "serial number of the device"},
)


def event_lines(spark, sf_dir) -> DataFrame:
    """``events`` as firewall lines: event_id, recv_ms and line. Errors become lines that no source knows."""
    # Dealt before the lines are made, as events are the shorter rows.
    e = spread(_with_ip(spark, sf_dir).drop("props"))
    ms = F.unix_millis("ts")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "traffic").otherwise("utm")
    action = F.when(F.col("event_type") == "purchase", "deny").otherwise("accept")
    line = F.format_string(
        '<189>devname="FW-%d" devid="D%d" logid="%010d" type="%s" subtype="forward" level="notice" eventtime=%d000000 srcip=%s srcport=%d dstip=192.168.%d.9 dstport=%d proto=%d action="%s" duration=%d sentbyte=%d note="a \\"b\\" c"',
        F.col("user_id") % 4, F.col("user_id"), F.col("event_id"), kind, ms, F.col("src_ip"), 1024 + F.col("event_id") % 60000, F.col("event_id") % 200, 1 + F.col("event_id") % 1000, F.when(F.col("event_id") % 2 == 0, 6).otherwise(17), action, F.col("event_id") % 90, F.floor(F.col("value")).cast("long"),
    )
    junk = F.concat(F.lit("disk "), F.col("user_id").cast("string"), F.lit(" failed at 10.0.0.1 code 0x1f"))
    return e.select("event_id", ms.alias("recv_ms"), F.when(F.col("event_type") == "error", junk).otherwise(line).alias("line"))


@query(
    """SELECT event_id, 'FW-' || (user_id % 4) AS devname, printf('%010d', event_id) AS logid, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || ((event_id * 7) % 256) AS srcip,
 (1024 + event_id % 60000)::VARCHAR AS srcport, 'a "b" c' AS note, 16 AS n_fields FROM events WHERE event_type <> 'error'"""
)
def kv_extract(spark, sf_dir):
    f = extract.kv(extract.syslog(F.col("line"), F.col("recv_ms"))["message"])
    lines = event_lines(spark, sf_dir).select("event_id", f.alias("f")).filter("f['logid'] IS NOT NULL")
    return lines.select("event_id", *[F.col("f")[k].alias(k) for k in ("devname", "logid", "srcip", "srcport", "note")], F.size("f").alias("n_fields"))


@query(
    """SELECT event_id, event_type AS kind, user_id::VARCHAR AS who, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 7)::VARCHAR END AS code FROM events"""
)
def regex_extract(spark, sf_dir):
    line = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" code="), (F.col("event_id") % 7).cast("string"))))
    f = extract.regex(line, r"user (?P<who>\d+) did (?P<kind>\w+)(?: code=(?P<code>\d+))?$")
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["kind"].alias("kind"), F.col("f")["who"].alias("who"), F.col("f")["code"].alias("code"))


@query(
    """SELECT event_id, 'Acme|X' AS vendor, event_type AS signature_id, user_id::VARCHAR AS suser, 'a b=c' AS msg, 9 AS n_fields FROM events"""
)
def cef_extract(spark, sf_dir):
    line = F.concat(F.lit("CEF:0|Acme\\|X|Wall|1.0|"), "event_type", F.lit("|name|5|suser="), F.col("user_id").cast("string"), F.lit(" msg=a b\\=c"))
    f = extract.cef(line)
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["cef.vendor"].alias("vendor"), F.col("f")["cef.signature_id"].alias("signature_id"), F.col("f")["suser"].alias("suser"), F.col("f")["msg"].alias("msg"), F.size("f").alias("n_fields"))


@query("SELECT event_id, user_id::VARCHAR AS usr, event_type AS cat, 7 AS n_fields FROM events")
def leef_extract(spark, sf_dir):
    line = F.concat(F.lit("LEEF:2.0|Acme|Wall|1|E1|x5E|usr="), F.col("user_id").cast("string"), F.lit("^cat="), "event_type")
    f = extract.leef(line)
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["usr"].alias("usr"), F.col("f")["cat"].alias("cat"), F.size("f").alias("n_fields"))


@query("SELECT event_id, user_id::VARCHAR AS uid, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, 'x' AS extra FROM events")
def tsv_extract(spark, sf_dir):
    line = F.concat_ws("\t", F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("-"), F.lit("(empty)"), F.lit("x"))
    f = extract.tsv(line, ["uid", "kind", "none"])
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["uid"].alias("uid"), F.col("f")["kind"].alias("kind"), F.col("f")["_extra"].alias("extra"))


@query("SELECT event_id, user_id::VARCHAR AS a, event_type || ', ok' AS b FROM events")
def csv_extract(spark, sf_dir):
    line = F.concat(F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit(', ok",'))
    f = extract.csv(line, ["a", "b", "c"])
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["a"].alias("a"), F.col("f")["b"].alias("b"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS inner_type, '[1,2]' AS list FROM events")
def json_flatten(spark, sf_dir):
    line = F.concat(F.lit('{"props":'), "props", F.lit(',"a":{"b":{"type":"'), "event_type", F.lit('"}},"l":[1,2],"none":{}}'))
    f = extract.json_fields(line)
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["props.k"].alias("k"), F.col("f")["a.b.type"].alias("inner_type"), F.col("f")["l"].alias("list"))


@query("SELECT event_id, user_id::VARCHAR AS user_name, '4624' AS code FROM events")
def xml_extract(spark, sf_dir):
    line = F.concat(F.lit('<Event xmlns="u"><System><EventID>4624</EventID></System><EventData><Data Name="User">'), F.col("user_id").cast("string"), F.lit("</Data></EventData></Event>"))
    f = extract.xml(line)
    return events(spark, sf_dir).select("event_id", f.alias("f")).select("event_id", F.col("f")["EventData.User"].alias("user_name"), F.col("f")["System.EventID"].alias("code"))


@query("SELECT event_id, 'host' || user_id AS host, 'said ' || event_type AS message, 134 AS priority, ((epoch_us(ts) // 1000) // 1000) * 1000 AS time_ms FROM events")
def syslog_header(spark, sf_dir):
    e = events(spark, sf_dir)
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    old = F.concat(F.lit("<134>"), F.date_format("ts", "MMM"), F.lit(" "), day, F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(" host"), F.col("user_id").cast("string"), F.lit(" said "), "event_type")
    new = F.concat(F.lit("<134>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" host"), F.col("user_id").cast("string"), F.lit(" app 1 ID - said "), "event_type")
    line = F.when(F.col("event_id") % 2 == 0, old).otherwise(new)
    return e.select("event_id", extract.syslog(line, F.unix_millis("ts")).alias("h")).select("event_id", "h.host", "h.message", "h.priority", "h.time_ms")


@query(
    """SELECT (event_id || ':0') AS event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 2004 ELSE 4001 END AS class_uid,
 CASE WHEN event_type = 'error' THEN 'unparsed' ELSE 'parsed' END AS status, CASE WHEN event_type = 'error' THEN 'unparsed' ELSE 'example.firewall' END AS source_id,
 (epoch_us(ts) // 1000) AS time_ms, CASE WHEN event_type <> 'error' THEN '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || ((event_id * 7) % 256) END AS src_ip,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 + event_id % 1000 END AS dst_port, CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type IN ('click', 'view') THEN 1 END AS action_id,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END END AS proto_name,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN floor(value)::BIGINT END AS bytes_out, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN (event_id % 90) * 1000 END AS duration_ms,
 CASE WHEN event_type = 'signup' THEN 'forward' END AS signature,
 round(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 4 / 16 ELSE 11 / 16 END, 4) AS coverage FROM events"""
)
def normalized_events(spark, sf_dir):
    """Lines to lake rows: detection, extraction, mapping and the unparsed rest."""
    gold = lake_rows(spark, sf_dir)
    return gold.select("event_id", "class_uid", "status", "source_id", F.unix_millis("time").alias("time_ms"), "src_ip", "dst_port", "action_id", "proto_name", "bytes_out", "duration_ms", "signature", F.round(F.col("coverage").cast("double"), 4).alias("coverage"))


def lake_rows(spark, sf_dir) -> DataFrame:
    raw = normalize.envelope(event_lines(spark, sf_dir), "line", "event_id", "recv_ms")
    return normalize.normalize(raw, [FIREWALL])


@query(f"SELECT ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS bucket_ms, count(*) FILTER (WHERE event_type NOT IN ('error')) AS parsed, 0 AS partial, count(*) FILTER (WHERE event_type = 'error') AS unparsed FROM events GROUP BY 1")
def flagship(spark, sf_dir):
    """Raw lines all the way to a histogram by status, counting each event once."""
    return stats.histogram(lake_rows(spark, sf_dir), "time", "status", ["parsed", "partial", "unparsed"], 86_400_000, distinct="event_id")


FLAGSHIP = flagship


@query(
    """SELECT src_ip, class_uid, n FROM (SELECT '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || ((event_id * 7) % 256) AS src_ip, CASE WHEN event_type = 'signup' THEN 2004 ELSE 4001 END AS class_uid, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2) ORDER BY n DESC, src_ip, class_uid LIMIT 50"""
)
def top_sources_of_lake(spark, sf_dir):
    gold = lake_rows(spark, sf_dir).filter("status = 'parsed'")
    return gold.groupBy("src_ip", "class_uid").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src_ip", "class_uid").limit(50)


# ---------------------------------------------------------------- behaviour, mining, integrity

_FEATURE_BASE = """(SELECT user_id::VARCHAR AS src, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS window_start, event_id % 50 AS dst, event_id % 300 AS dport, CASE WHEN event_type = 'signup' THEN 3002 ELSE 4001 END AS cls,
 event_type = 'error' AS deny, floor(value)::BIGINT AS bytes_out, event_type = 'signup' AND event_id % 2 = 0 AS auth_fail, 's' || (event_id % 3) AS source, (epoch_us(ts) // 1000) AS t_ms, event_id::VARCHAR AS ref FROM events)"""


def _feature_rows(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.unix_millis("ts").alias("t_ms"), F.col("user_id").cast("string").alias("src"), (F.col("event_id") % 50).alias("dst"), (F.col("event_id") % 300).alias("dport"), F.when(F.col("event_type") == "signup", 3002).otherwise(4001).alias("cls"), (F.col("event_type") == "error").alias("deny"), F.floor("value").cast("long").alias("bytes_out"), ((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0)).alias("auth_fail"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"), F.col("event_id").cast("string").alias("ref")
    )


_FEATURES = """count(*) FILTER (WHERE cls = 4001) AS conn_count, count(DISTINCT dst) AS uniq_dst_ip, count(DISTINCT dport) AS uniq_dst_port,
 round(count(*) FILTER (WHERE deny) / (count(*) FILTER (WHERE cls = 4001) + 4), 9) AS deny_ratio, sum(bytes_out)::BIGINT AS bytes_out_sum, count(*) FILTER (WHERE auth_fail) AS auth_fail_count, count(DISTINCT source) AS uniq_sources, count(*) AS events"""


@query(f"SELECT src, window_start, {_FEATURES} FROM {_FEATURE_BASE} GROUP BY 1, 2")
def window_features(spark, sf_dir):
    return features.windows(_feature_rows(spark, sf_dir), 3_600_000, evidence=0).withColumn("deny_ratio", F.round("deny_ratio", 9))


@query(
    f"""SELECT src, window_start, string_agg(ref, ',' ORDER BY t_ms, ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY src, window_start ORDER BY t_ms, ref) AS n FROM {_FEATURE_BASE} WHERE deny OR auth_fail OR bytes_out > 0) WHERE n <= 20 GROUP BY 1, 2"""
)
def evidence_first_20(spark, sf_dir):
    made = features.windows(_feature_rows(spark, sf_dir), 3_600_000)
    return made.filter("refs IS NOT NULL").select("src", "window_start", F.concat_ws(",", "refs").alias("refs"))


@query(
    """WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m)
 SELECT event_id, round((value - m) / greatest(d * 1.4826, 0.5), 6) AS z FROM events, m, d"""
)
def robust_zscore(spark, sf_dir):
    return features.robust_z(events(spark, sf_dir).select("event_id", "value"), ["value"], [0.5]).select("event_id", F.round("z_value", 6).alias("z"))


_CENTRES = [f"v_{f}" for f in features.FEATURES]


@query(
    f"""WITH f AS (SELECT count(*) FILTER (WHERE cls = 4001) AS conn_count, count(DISTINCT dst) AS uniq_dst_ip, count(DISTINCT dport) AS uniq_dst_port, count(*) FILTER (WHERE deny) / (count(*) FILTER (WHERE cls = 4001) + 4) AS deny_ratio, sum(bytes_out) AS bytes_out_sum, count(*) FILTER (WHERE auth_fail) AS auth_fail_count, count(DISTINCT source) AS uniq_sources FROM {_FEATURE_BASE} GROUP BY src, window_start),
 v AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature, {x if x in features.RATIOS else f'ln(1 + {x})'}::DOUBLE AS v FROM f" for x in features.FEATURES)}), m AS (SELECT feature, median(v) AS m FROM v GROUP BY 1), d AS (SELECT feature, median(abs(v - m)) AS d FROM v JOIN m USING (feature) GROUP BY 1)
 SELECT feature, round(m, 6) AS median, round(d, 6) AS deviation, round(CASE WHEN feature IN ({", ".join(f"'{x}'" for x in sorted(features.RATIOS))}) THEN m ELSE exp(m) - 1 END, 6) AS baseline FROM m JOIN d USING (feature)"""
)
def feature_baselines(spark, sf_dir):
    """What is usual for each feature of a window, as findings show it: medians, deviations, and the former on the feature's scale."""
    known = features.centres(features.vector(features.windows(_feature_rows(spark, sf_dir), 3_600_000, evidence=0)), _CENTRES)
    usual = features.baselines(known)
    rows = [(f, known[f"v_{f}"][0], known[f"v_{f}"][1], usual[f]) for f in features.FEATURES]
    out = spark.createDataFrame(rows, "feature string, median double, deviation double, baseline double")
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("median", "deviation", "baseline")])


@query()
def anomaly_findings(spark, sf_dir):
    """Windows, forest, robust scores and flags: the windows' scores, with whether they are findings."""
    made = cut(features.vector(features.windows(_feature_rows(spark, sf_dir), 3_600_000, evidence=0)))
    columns = [f"v_{f}" for f in features.FEATURES]
    scored = features.robust_z(features.score_forest(made, features.fit_forest(made, columns), columns), columns, list(features.FLOORS))
    flagged = features.flag(scored, 0.6, [f"z_{c}" for c in columns])
    return flagged.select("src", "window_start", "score", "zmax", "flagged")


_MASKED = "text"
for _pattern, _name in text.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{_name}', 'g')"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


def _text_lines(spark, sf_dir) -> DataFrame:
    return spread(read(spark, sf_dir, "documents")).filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))


@query(f"SELECT substr(sha256(template), 1, 16) AS template_id, n, round(n / sum(n) OVER (), 9) AS share, first_key, last_key FROM (SELECT {_MASKED} AS template, count(*) AS n, min(doc_id) AS first_key, max(doc_id) AS last_key FROM {_LINES} GROUP BY 1)")
def template_counts(spark, sf_dir):
    found = mining.templates(_text_lines(spark, sf_dir), "text", "doc_id", samples=0)
    return found.select("template_id", "n", F.round("share", 9).alias("share"), "first_key", "last_key")


def _fold_sql(source: str, level: int) -> str:
    """The nodes of a level as one sequential fold each: a list of clusters that every member joins or adds to."""
    branch = ", ".join(["len(w)", *[f"CASE WHEN contains(w[{k}], '<') THEN '' ELSE coalesce(w[{k}], '') END" for k in range(1, level + 1)]])
    same = "list_transform(acc, lambda c: list_sum(list_transform(list_zip(c.w, x[1].w), lambda z: CASE WHEN z[1] = z[2] OR z[1] = '<*>' THEN 1 ELSE 0 END)))"
    wider = "{'w': list_transform(list_zip(acc[p].w, x[1].w), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END), 'n': acc[p].n + x[1].n, 'parts': acc[p].parts + x[1].parts}"
    joined = f"list_transform([list_position(s, list_max(s))], lambda p: list_concat(acc[:p - 1], [{wider}], acc[p + 1:]))[1]"
    step = f"list_transform([{same}], lambda s: CASE WHEN 2 * list_max(s) >= len(x[1].w) THEN {joined} ELSE list_concat(acc, x) END)[1]"
    return f"SELECT c.w AS w, c.n AS n, c.parts AS parts FROM (SELECT unnest(list_reduce(list([{{'w': w, 'n': n, 'parts': parts}}] ORDER BY n DESC, array_to_string(w, ' ')), lambda acc, x: {step})) AS c FROM {source} GROUP BY {branch})"


@query(
    f"""WITH once AS (SELECT list_filter(regexp_split_to_array(template, '[ \t]+'), lambda w: w <> '') AS w, count(*)::BIGINT AS n, 1::BIGINT AS parts FROM (SELECT {_MASKED} AS template FROM {_LINES}) GROUP BY 1),
 leaves AS (SELECT CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w, n, parts FROM once),
 two AS ({_fold_sql("leaves", 2)}), one AS ({_fold_sql("two", 1)}), root AS ({_fold_sql("one", 0)})
 SELECT array_to_string(w, ' ') AS template, n, parts FROM root"""
)
def merged_templates(spark, sf_dir):
    """Wide templates of all lines of the documents."""
    counts = _text_lines(spark, sf_dir).groupBy(text.mask(F.col("text")).alias("template")).agg(F.count("*").alias("n"))
    return mining.merged_templates(counts)


@query(
    """WITH f AS (SELECT lang, CASE WHEN text LIKE '{%' THEN 'json' WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS value FROM documents),
 c AS (SELECT lang, value, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, value) AS i, sum(n) OVER (PARTITION BY lang) AS a FROM c)
 SELECT lang, value, n, round(n / a, 6) AS share FROM r WHERE i = 1"""
)
def format_majority_vote(spark, sf_dir):
    value = F.when(F.col("text").startswith("{"), "json").when(F.length("text") > 1000, "long").otherwise("short")
    return mining.majority(read(spark, sf_dir, "documents"), value, "lang")


@query(
    """WITH v AS (SELECT 'key' AS name, p_partkey::VARCHAR AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'price', p_retailprice::VARCHAR FROM part UNION ALL SELECT 'name', p_name FROM part),
 s AS (SELECT name, count(*) AS support, count(DISTINCT value) AS "values", avg(regexp_matches(value, '^[+-]?\\d{1,18}$')::INT) AS i, avg(regexp_matches(value, '^[+-]?\\d+(\\.\\d+)?$')::INT) AS f FROM v WHERE value IS NOT NULL GROUP BY 1)
 SELECT name, CASE WHEN i >= 0.95 THEN 'int' WHEN f >= 0.95 THEN 'float' WHEN "values" <= 12 AND "values" <= support * 0.25 THEN 'enum' ELSE 'string' END AS type, support, "values" FROM s"""
)
def type_inference(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    pairs = p.select(F.explode(F.create_map(F.lit("key"), F.col("p_partkey").cast("string"), F.lit("brand"), "p_brand", F.lit("price"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("name"), "p_name")).alias("name", "value"))
    return mining.field_types(pairs)


@query("SELECT user_id, event_id - gap - 1 AS after, event_id AS found, gap AS missing FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gap FROM events) WHERE gap > 0")
def sequence_gaps(spark, sf_dir):
    return integrity.gaps(events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id")


@query(
    """WITH f AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100 AS block, sha256(props) AS s FROM events)
 SELECT user_id AS shard, block, count(*) AS rows, sha256(string_agg(s, '' ORDER BY event_id)) AS block_hash FROM f GROUP BY 1, 2"""
)
def block_hashes(spark, sf_dir):
    stored = integrity.frames(events(spark, sf_dir).select("user_id", "event_id", "props"), "user_id", [F.col("event_id")], "props", 100)
    return integrity.block_hashes(stored, "user_id")


@query(
    """WITH RECURSIVE f AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100 AS block, sha256(props) AS s FROM events),
 b AS (SELECT user_id AS shard, block, count(*) AS rows, sha256(string_agg(s, '' ORDER BY event_id)) AS block_hash FROM f GROUP BY 1, 2),
 c AS (SELECT shard, block, rows, block_hash, sha256(repeat('0', 64) || block_hash) AS chain_hash FROM b WHERE block = 0
 UNION ALL SELECT b.shard, b.block, b.rows, b.block_hash, sha256(c.chain_hash || b.block_hash) FROM c JOIN b ON b.shard = c.shard AND b.block = c.block + 1)
 SELECT shard, block, 0 AS bad_frames, TRUE AS hash_ok, TRUE AS link_ok, TRUE AS number_ok FROM c"""
)
def chain_verify(spark, sf_dir):
    """A chain is made and checked: every block must hold."""
    stored = integrity.frames(events(spark, sf_dir).select("user_id", "event_id", "props"), "user_id", [F.col("event_id")], "props", 100)
    return integrity.verify(stored, integrity.chain(integrity.block_hashes(stored, "user_id")), "user_id", "props")


@query("SELECT sha, count(*) AS n_in, count(*) FILTER (WHERE lang IS NULL OR lang <> 'de') AS n_out FROM (SELECT sha256(text) AS sha, lang FROM documents) GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE lang IS NULL OR lang <> 'de')")
def conservation_check(spark, sf_dir):
    """Rows that a faulty sink lost (here: all of one language) show up by hash; equal texts elsewhere don't hide them."""
    d = read(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("sha"))
    return integrity.conservation(d, d.filter("lang IS NULL OR lang <> 'de'"), "sha")


@query("WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), k AS (SELECT DISTINCT (j * n) // 100 AS i FROM (SELECT max(n) AS n FROM s), range(100) t(j)) SELECT event_id FROM s JOIN k USING (i)")
def stride_sample(spark, sf_dir):
    return rows.stride_sample(events(spark, sf_dir).select("event_id"), [F.col("event_id").asc()], 100)


@query("SELECT coalesce(v, 'none') AS violations, count(*) AS n FROM (SELECT event_id, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT event_id, unnest([CASE WHEN value < 10 THEN 'value_low' END, CASE WHEN event_type = 'error' THEN 'type_error' END, CASE WHEN user_id % 5 = 0 THEN 'user_banned' END]) AS v FROM events) GROUP BY 1) GROUP BY 1")
def validation(spark, sf_dir):
    """Rule violations of each row as a list, counted by combination."""
    from ..operators.validate import violations

    rules = {"value_low": F.col("value") < 10, "type_error": F.col("event_type") == "error", "user_banned": F.col("user_id") % 5 == 0}
    listed = events(spark, sf_dir).select(violations(rules).alias("v"))
    return listed.groupBy(F.when(F.size("v") == 0, "none").otherwise(F.array_join("v", ",")).alias("violations")).agg(F.count("*").alias("n"))

