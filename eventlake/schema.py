"""The lake's row, its classes and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order and types of the stored rows, class numbers and enumerations of the event schema (OCSF 1.3).
GOLD = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("event_id", "raw_ref", "raw_sha256")],
        *[T.StructField(n, T.TimestampType()) for n in ("time", "recv_time")],
        *[T.StructField(n, T.IntegerType()) for n in ("class_uid", "activity_id", "severity_id", "action_id")],
        *[T.StructField(n, T.StringType()) for n in ("status", "source_id", "src_ip")],
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto_name", T.StringType()),
        T.StructField("proto_num", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("bytes_in", "bytes_out", "packets_in", "packets_out", "duration_ms")],
        *[T.StructField(n, T.StringType()) for n in ("user_name", "url", "http_method")],
        T.StructField("http_status", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("dns_query", "signature", "device_host")],
        T.StructField("coverage", T.FloatType()),
        *[T.StructField(n, T.StringType()) for n in ("unmapped", "event")],
    ]
)
#: Bytes of one raw event; the rest is cut and the event marked.
LONGEST = 64 * 1024
CLASSES = {"base_event": 0, "detection_finding": 2004, "authentication": 3002, "network_activity": 4001, "http_activity": 4002, "dns_activity": 4003}
CATEGORIES = {0: 0, 2004: 2, 3002: 3, 4001: 4, 4002: 4, 4003: 4}
STATUSES = ("parsed", "partial", "unparsed")
ACTIONS = {"allowed": 1, "allow": 1, "permitted": 1, "denied": 2, "deny": 2, "blocked": 2, "block": 2, "unknown": 0}
# Columns of a row in a list of events, those whose values are suggested, and what a valid event holds.
ROW_COLUMNS = "event_id raw_ref time recv_time class_uid activity_id severity_id action_id status source_id src_ip src_port dst_ip dst_port proto_name bytes_in bytes_out user_name url dns_query signature device_host coverage".split()
SUGGESTED = frozenset("source_id device_host user_name signature dns_query proto_name http_method url".split())
ACTIVITIES = {0: (0, 1), 2004: (0, 1, 2, 3, 99), 3002: (0, 1, 2, 3, 4, 5, 6, 99), 4001: (0, 1, 2, 3, 4, 5, 6, 7, 99), 4002: (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99), 4003: (0, 1, 2, 6, 99)}
ACTION_IDS = (0, 1, 2, 3, 4, 99)
SEVERITY_IDS = (0, 1, 2, 3, 4, 5, 6, 99)
STATUS_IDS = (0, 1, 2, 99)
DISPOSITION_IDS = (*range(28), 99)
#: Latest time of an event, in epoch milliseconds.
LATEST_MS = 8_204_889_600_000
#: Columns that a search may name; the others are documents or hashes.
SEARCHABLE = tuple(f.name for f in GOLD.fields if f.name not in ("raw_sha256", "unmapped", "event"))
CASE_INSENSITIVE = frozenset(["url", "signature", "dns_query", "user_name", "device_host", "proto_name", "http_method"])
IP_FIELDS = frozenset(["src_ip", "dst_ip"])
#: Names of protocol numbers (IANA).
PROTOCOLS = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 41: "ipv6", 47: "gre", 50: "esp", 51: "ah", 58: "icmpv6", 89: "ospf", 132: "sctp"}
