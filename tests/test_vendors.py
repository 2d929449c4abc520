import pytest

from eventlake.operators import normalize
from eventlake.sources import vendors
from eventlake.streaming.pipeline import RAW

RECEIVED = 1_791_120_600_000  # 2026-10-04 13:30 UTC
LINES = {
    "fortinet.fortigate": ('<189>date=2026-10-04 time=13:00:00 devname="F1" logid="2" type="utm" subtype="ips" level="alert" attack="Worm A" srcip=10.0.0.7 dstip=10.0.0.8', {"class_uid": 2004, "signature": "Worm A", "severity_id": 4, "time_ms": RECEIVED - 1_800_000, "src_ip": "10.0.0.7", "device_host": "F1"}),
    "cisco.asa": ("<166>Oct 04 2026 13:30:00 EDGE : %ASA-6-302013: Built outbound TCP connection 12 for outside:192.0.2.5/443 (192.0.2.5/443) to inside:10.1.2.10/5000 (10.1.2.10/5000)", {"class_uid": 4001, "activity_id": 1, "src_ip": "10.1.2.10", "src_port": 5000, "dst_ip": "192.0.2.5", "dst_port": 443, "proto_num": 6, "action_id": 1, "device_host": "EDGE", "time_ms": RECEIVED}),
    "suricata.eve": ('{"timestamp":"2026-10-04T13:30:00.000000+0000","event_type":"alert","src_ip":"192.0.2.7","src_port":4,"dest_ip":"10.1.2.2","dest_port":22,"proto":"TCP","alert":{"action":"blocked","signature_id":9,"signature":"SCAN","severity":2},"host":"s1"}', {"class_uid": 2004, "signature": "SCAN", "severity_id": 3, "action_id": 2, "dst_port": 22, "proto_name": "tcp", "time_ms": RECEIVED}),
    "squid.access": ("1791120600.250    145 10.1.1.5 TCP_DENIED/403 120 CONNECT host:443 - HIER_NONE/- text/html", {"class_uid": 4002, "activity_id": 1, "action_id": 2, "http_status": 403, "url": "host:443", "user_name": None, "duration_ms": 145, "time_ms": RECEIVED + 250}),
    "zeek.conn": ("1791120600.5\tCabcdefghij1\t10.1.1.5\t1\t10.1.1.6\t53\tUDP\tdns\t0.25\t60\t-\tSF\t-\t-\t0\tDd\t1\t88\t1\t99\t(empty)", {"class_uid": 4001, "duration_ms": 250, "bytes_out": 60, "bytes_in": None, "packets_in": 1, "proto_name": "udp", "time_ms": RECEIVED + 500}),
    "windows.event_xml": ('<Event xmlns="w"><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>4625</EventID><TimeCreated SystemTime="2026-10-04T13:30:00.1234567Z"/><Computer>DC</Computer></System><EventData><Data Name="TargetUserName">eve</Data><Data Name="IpAddress">10.9.9.9</Data><Data Name="IpPort">70000</Data></EventData></Event>', {"class_uid": 3002, "user_name": "eve", "src_ip": "10.9.9.9", "src_port": None, "severity_id": 2, "time_ms": RECEIVED + 123}),
    "dns.dnsmasq": ("<30>Oct  4 13:30:00 gw dnsmasq[12]: query[AAAA] WWW.example.com from 10.1.1.5", {"class_uid": 4003, "dns_query": "www.example.com", "activity_id": 1, "src_ip": "10.1.1.5", "device_host": "gw", "time_ms": RECEIVED}),
    "leef.generic": ("<134>Oct  4 13:30:00 L1 LEEF:2.0|Acme|Net|2|X|^|devTime=1791120600000^devName=L1^src=10.1.1.5^dst=10.1.1.6^dstPort=80^action=DROP^sev=9", {"class_uid": 4001, "action_id": 2, "severity_id": 5, "dst_port": 80, "device_host": "L1", "time_ms": RECEIVED}),
    "cef.generic_firewall": ("<134>Oct  4 13:30:00 C1 CEF:0|Acme|Net|2|100|Allowed|3|rt=1791120600000 src=10.1.1.5 spt=7 dst=10.1.1.6 dpt=443 act=allow in=14 out=31 dvchost=C1", {"class_uid": 4001, "action_id": 1, "severity_id": 2, "src_port": 7, "bytes_out": 14, "bytes_in": 31, "time_ms": RECEIVED}),
    "pfsense.filterlog": ("<134>1 2026-10-04T13:30:00+00:00 pf.local filterlog 85 - - 5,,,100,igb0,match,block,in,4,0x0,,64,12,0,none,17,udp,60,192.0.2.7,10.0.0.5,444,53,20", {"class_uid": 4001, "action_id": 2, "src_ip": "192.0.2.7", "dst_port": 53, "proto_num": 17, "proto_name": "udp", "device_host": "pf.local", "time_ms": RECEIVED}),
}


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([(k, RECEIVED, line) for k, (line, _) in LINES.items()] + [("none", RECEIVED, "of no source")], RAW)
    out = normalize.normalize(normalize.envelope(raw, "line", "raw_id", "recv_ms"), vendors.ALL)
    return {r.source_id: r for r in out.withColumn("time_ms", F.unix_millis("time")).collect()}


@pytest.mark.parametrize("source", sorted(LINES))
def test_source(rows, source):
    expect = LINES[source][1]
    assert {k: rows[source][k] for k in expect} == expect and rows[source].status == "parsed"


def test_every_line_has_a_row(rows):
    assert set(rows) == {*LINES, "unparsed"}
