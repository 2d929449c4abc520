"""Ten log sources as mappings. Field names, message numbers and value tables are those of the vendors' formats."""

from __future__ import annotations

from ..operators.mapping import Source


def _of(field: str, *pipe) -> dict:
    return {"from": field, "pipe": list(pipe)}


def _table(field: str, table: dict, default=None, *before) -> dict:
    return {"from": field, "pipe": [*before, ("lookup", {"map": table, "default": default})]}


def _ends(src: str, sport: str, dst: str, dport: str) -> dict:
    """Addresses and ports of both ends."""
    return {"src_endpoint.ip": _of(src, "ip"), "src_endpoint.port": _of(sport, "int", "port"), "dst_endpoint.ip": _of(dst, "ip"), "dst_endpoint.port": _of(dport, "int", "port")}


def _traffic(**fields: str) -> dict:
    return {f"traffic.{k}": _of(v, "int") for k, v in fields.items()}


def _acted(expr: dict) -> dict:
    return {"action_id": expr, "disposition_id": expr}


TRAFFIC, LOGON, FINDING = {"const": 6}, {"const": 1}, {"const": 1}

# Tables of the formats, from a source's word to the event schema's number.
FORTI_LEVELS = {"debug": 1, "information": 1, "notice": 1, "warning": 2, "error": 3, "alert": 4, "critical": 5, "emergency": 6}
FORTI_ACTIONS = {"accept": 1, "close": 1, "timeout": 1, "deny": 2, "client-rst": 2, "server-rst": 2}
SYSLOG_SEVERITY = {"0": 6, "1": 5, "2": 5, "3": 4, "4": 3, "5": 2, "6": 1, "7": 1}
TEN_POINT_SEVERITY = {"0": 2, "1": 2, "2": 2, "3": 2, "4": 3, "5": 3, "6": 3, "7": 4, "8": 4, "9": 5, "10": 5}
VERDICTS = {"allow": 1, "permit": 1, "accept": 1, "allowed": 1, "deny": 2, "drop": 2, "block": 2, "reject": 2, "denied": 2}
HTTP_METHODS = {"CONNECT": 1, "DELETE": 2, "GET": 3, "HEAD": 4, "OPTIONS": 5, "POST": 6, "PUT": 7, "TRACE": 8, "PATCH": 9}
ASA_ACTIVITY = {"302013": 1, "302015": 1, "302014": 2, "302016": 2, "106023": 5, "106100": 5, "710003": 5}
ASA_ACTIONS = {"302013": 1, "302014": 1, "302015": 1, "302016": 1, "106023": 2, "710003": 2}
ZEEK_CONN = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents".split()

_forti_time = {"coalesce": [_of("eventtime", "int", "epoch_ns"), {"from": ["date", "time"], "pipe": [("concat", " "), ("strptime", {"fmt": "%Y-%m-%d %H:%M:%S", "tz_from": "tz"})]}]}
_forti_severity = _table("level", FORTI_LEVELS, 0)
FORTIGATE = Source(
    id="fortinet.fortigate",
    match=[("contains", "devname="), ("contains", "logid=")],
    kind="kv",
    framing="syslog",
    select=[("type", "traffic", "network_activity"), ("type", "utm", "detection_finding")],
    classes={
        "network_activity": {
            "activity_id": TRAFFIC,
            "time": _forti_time,
            "severity_id": _forti_severity,
            "action_id": _table("action", FORTI_ACTIONS, 0),
            **_ends("srcip", "srcport", "dstip", "dstport"),
            "src_endpoint.interface_name": "srcintf",
            "dst_endpoint.interface_name": "dstintf",
            "connection_info.protocol_num": _of("proto", "int"),
            "connection_info.protocol_name": _of("proto", "int", "proto_name"),
            **_traffic(bytes_out="sentbyte", bytes_in="rcvdbyte", packets_out="sentpkt", packets_in="rcvdpkt"),
            "duration": _of("duration", "int", ("mul", 1000)),
            "device.hostname": "devname",
        },
        "detection_finding": {
            "activity_id": FINDING,
            "time": _forti_time,
            "severity_id": _forti_severity,
            "finding_info.title": {"coalesce": ["attack", "msg", "subtype"]},
            "finding_info.uid": "logid",
            "src_endpoint.ip": _of("srcip", "ip"),
            "dst_endpoint.ip": _of("dstip", "ip"),
            "device.hostname": "devname",
        },
        "base_event": {"time": _of("eventtime", "int", "epoch_ns"), "severity_id": _forti_severity, "message": {"coalesce": ["msg", "logdesc"]}, "device.hostname": "devname"},
    },
)


def _asa_end(prefix: str) -> str:
    """An interface, address and port of a connection message, as groups named with ``prefix``."""
    return rf"(?P<{prefix}if>[^:/\s]+):(?P<{prefix}ip>[^/\s]+)/(?P<{prefix}port>\d+)"


_built = rf"Built (?P<dir>\w+) (?P<proto>\w+) connection (?P<connid>\d+) for {_asa_end('s')} \S+ to {_asa_end('d')}"
_teardown = rf"Teardown (?P<proto>\w+) connection (?P<connid>\d+) for {_asa_end('s')} to {_asa_end('d')}.*? duration (?P<duration>[\d:]+) bytes (?P<bytes>\d+)(?: (?P<reason>.+))?$"
_rejected = r"AAA user authentication Rejected : reason = (?P<reason>[^:]+) : .*?user = (?P<user>\S*) : user IP = (?P<uip>\S+)"
_asa_time = {"from": "ts", "pipe": [("strptime", {"fmt": "%b %d %Y %H:%M:%S"})]}
_asa_severity = _table("sev", SYSLOG_SEVERITY, 0)


def _outbound(yes: dict | str, no: dict | str) -> dict:
    """Messages of outbound connections name the foreign end first."""
    return {"when": "dir", "eq": "outbound", "then": yes, "else": no}


_asa_action = {"when": "msgid", "eq": "106100", "then": _table("verdict", {"permitted": 1, "est-allowed": 1, "denied": 2}, 0), "else": _table("msgid", ASA_ACTIONS, 0)}
ASA = Source(
    id="cisco.asa",
    match=[("contains", "%ASA-")],
    kind="dispatch",
    options={
        "anchor": r"^(?:<\d+>)?(?:(?P<ts>[A-Z][a-z]{2} +\d+ (?:\d{4} )?[\d:]{8}):? )?(?:(?P<host>[^\s:%]+) ?:? ?)?%ASA-(?P<sev>\d)-(?P<msgid>\d+): (?P<body>.*)$",
        "on": "msgid",
        "text": "body",
        "patterns": {
            "302013": _built,
            "302015": _built,
            "302014": _teardown,
            "302016": _teardown,
            "106023": rf'Deny (?P<proto>\w+) src {_asa_end("s")} dst {_asa_end("d")}.* by access-group "(?P<acl>[^"]+)"',
            "106100": r"access-list (?P<acl>\S+) (?P<verdict>\S+) (?P<proto>\w+) (?P<sif>[^/\s]+)/(?P<sip>[^(]+)\((?P<sport>\d+)\).* -> (?P<dif>[^/\s]+)/(?P<dip>[^(]+)\((?P<dport>\d+)\).* hit-cnt (?P<hits>\d+)",
            "710003": r"(?P<proto>\w+) access denied by ACL from (?P<sip>[^/\s]+)/(?P<sport>\d+) to (?P<dif>[^:\s]+):(?P<dip>[^/\s]+)/(?P<dport>\d+)",
            "113005": _rejected,
            "113015": _rejected,
        },
    },
    select=[*[("msgid", m, "network_activity") for m in ASA_ACTIVITY], ("msgid", "113005", "authentication"), ("msgid", "113015", "authentication")],
    ignore={"body": "the rest of the message, of which the dispatched fields are parts"},
    classes={
        "network_activity": {
            "activity_id": _table("msgid", ASA_ACTIVITY, 6),
            "time": _asa_time,
            "severity_id": _asa_severity,
            **_acted(_asa_action),
            "src_endpoint.ip": _outbound(_of("dip", "ip"), _of("sip", "ip")),
            "src_endpoint.port": _outbound(_of("dport", "int", "port"), _of("sport", "int", "port")),
            "src_endpoint.interface_name": _outbound("dif", "sif"),
            "dst_endpoint.ip": _outbound(_of("sip", "ip"), _of("dip", "ip")),
            "dst_endpoint.port": _outbound(_of("sport", "int", "port"), _of("dport", "int", "port")),
            "dst_endpoint.interface_name": _outbound("sif", "dif"),
            "connection_info.protocol_name": _of("proto", "lower"),
            "connection_info.protocol_num": _table("proto", {"tcp": 6, "udp": 17, "icmp": 1}, None, "lower"),
            "connection_info.uid": "connid",
            "traffic.bytes": _of("bytes", "int"),
            "device.hostname": "host",
        },
        "authentication": {"activity_id": LOGON, "status_id": {"const": 2}, "time": _asa_time, "severity_id": _asa_severity, "user.name": "user", "src_endpoint.ip": _of("uip", "ip"), "device.hostname": "host"},
        "base_event": {"time": _asa_time, "severity_id": _asa_severity, "message": "body", "device.hostname": "host"},
    },
)

_eve = {"time": _of("timestamp", "iso8601"), "device.hostname": "host"}
_eve_ends = {**_ends("src_ip", "src_port", "dest_ip", "dest_port"), "connection_info.protocol_name": _of("proto", "lower")}
SURICATA = Source(
    id="suricata.eve",
    match=[("starts_with", "{"), ("contains", '"event_type"')],
    kind="json",
    select=[("event_type", "alert", "detection_finding"), ("event_type", "flow", "network_activity")],
    classes={
        "detection_finding": {**_eve, "activity_id": FINDING, "severity_id": _table("alert.severity", {"1": 4, "2": 3, "3": 2}, 0), **_acted(_table("alert.action", {"allowed": 1, "blocked": 2}, 0)), "finding_info.title": "alert.signature", "finding_info.uid": "alert.signature_id", **_eve_ends},
        "network_activity": {**_eve, "activity_id": TRAFFIC, "severity_id": {"const": 1}, **_eve_ends, **_traffic(bytes_out="flow.bytes_toserver", bytes_in="flow.bytes_toclient", packets_out="flow.pkts_toserver", packets_in="flow.pkts_toclient"), "duration": _of("flow.age", "int", ("mul", 1000))},
        "base_event": {**_eve, "severity_id": {"const": 1}},
    },
)

SQUID = Source(
    id="squid.access",
    match=[("regex", r"^\d{9,10}\.\d{3}\s")],
    kind="regex",
    options={"pattern": r"^(?P<ts>\d+\.\d+)\s+(?P<elapsed>\d+)\s+(?P<client>\S+)\s+(?P<result>\w+)/(?P<status>\d+)\s+(?P<bytes>\d+)\s+(?P<method>\w+)\s+(?P<url>\S+)\s+(?:-|(?P<user>\S+))\s+(?P<hier>\w+)/(?:-|(?P<peer>\S+))\s+(?:-|(?P<mime>\S+))\s*$"},
    otherwise="http_activity",
    classes={
        "http_activity": {
            "activity_id": _table("method", HTTP_METHODS, 99, "upper"),
            "time": _of("ts", "epoch_s"),
            "severity_id": {"const": 1},
            **_acted(_table("result", {"TCP_DENIED": 2, "TCP_DENIED_REPLY": 2}, 1)),
            "src_endpoint.ip": _of("client", "ip"),
            "dst_endpoint.ip": _of("peer", "ip"),
            "http_request.http_method": "method",
            "http_request.url.text": "url",
            "http_response.code": _of("status", "int"),
            "traffic.bytes_in": _of("bytes", "int"),
            "duration": _of("elapsed", "int"),
            "actor.user.name": "user",
        }
    },
)

ZEEK = Source(
    id="zeek.conn",
    priority=40,
    match=[("regex", r"^\d{9,10}\.\d+\t[A-Za-z0-9]{10,18}\t")],
    kind="tsv",
    options={"fields": ZEEK_CONN},
    otherwise="network_activity",
    classes={
        "network_activity": {
            "activity_id": TRAFFIC,
            "time": _of("ts", "epoch_s"),
            "severity_id": {"const": 1},
            **_ends("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"),
            "connection_info.protocol_name": _of("proto", "lower"),
            "connection_info.uid": "uid",
            **_traffic(bytes_out="orig_bytes", bytes_in="resp_bytes", packets_out="orig_pkts", packets_in="resp_pkts"),
            "duration": _of("duration", "float", ("mul", 1000), "whole"),
        }
    },
)

_win_time = _of("System.TimeCreated.@SystemTime", "iso8601")
WINDOWS = Source(
    id="windows.event_xml",
    match=[("contains", "<Event"), ("contains", "Microsoft-Windows-Security-Auditing")],
    kind="xml",
    select=[("System.EventID", "4624", "authentication"), ("System.EventID", "4625", "authentication")],
    classes={
        "authentication": {
            "activity_id": LOGON,
            "time": _win_time,
            "status_id": _table("System.EventID", {"4624": 1, "4625": 2}),
            "severity_id": _table("System.EventID", {"4624": 1, "4625": 2}, 0),
            "user.name": "EventData.TargetUserName",
            "user.domain": "EventData.TargetDomainName",
            "logon_type_id": _of("EventData.LogonType", "int"),
            "src_endpoint.ip": _of("EventData.IpAddress", "ip"),
            "src_endpoint.port": _of("EventData.IpPort", "int", "port"),
            "src_endpoint.hostname": "EventData.WorkstationName",
            "dst_endpoint.hostname": "System.Computer",
            "auth_protocol": "EventData.AuthenticationPackageName",
        },
        "base_event": {"time": _win_time, "severity_id": {"const": 1}, "device.hostname": "System.Computer"},
    },
)

_syslog = {"time": _of("syslog.time_ms", "int"), "device.hostname": "syslog.host"}
_is = r"(?P<name>\S+) is (?P<answer>\S+)"
DNSMASQ = Source(
    id="dns.dnsmasq",
    match=[("contains", "dnsmasq[")],
    kind="dispatch",
    framing="syslog",
    options={"anchor": r"^(?P<kind>query|reply|cached|cached-stale|forwarded|config)(?:\[(?P<qtype>\w+)\])? (?P<body>.*)$", "on": "kind", "text": "body", "patterns": {"query": r"(?P<name>\S+) from (?P<client>\S+)", "forwarded": r"(?P<name>\S+) to (?P<upstream>\S+)", **dict.fromkeys(("reply", "cached", "cached-stale", "config"), _is)}},
    select=[("kind", k, "dns_activity") for k in ("query", "reply", "cached")],
    ignore={"body": "text after the verb, of which the dispatched fields are parts"},
    classes={
        "dns_activity": {**_syslog, "activity_id": _table("kind", {"query": 1, "reply": 2, "cached": 2}, 99), "severity_id": {"const": 1}, "query.hostname": _of("name", "lower"), "query.type": _of("qtype", "upper"), "src_endpoint.ip": _of("client", "ip")},
        "base_event": {**_syslog, "severity_id": {"const": 1}, "message": "body"},
    },
)

LEEF = Source(
    id="leef.generic",
    priority=30,
    match=[("contains", "LEEF:")],
    kind="leef",
    framing="syslog",
    otherwise="network_activity",
    classes={
        "network_activity": {
            "activity_id": TRAFFIC,
            "time": _of("devTime", "int", "epoch_ms"),
            "severity_id": _table("sev", TEN_POINT_SEVERITY, 0),
            **_acted(_table("action", VERDICTS, 0, "lower")),
            **_ends("src", "srcPort", "dst", "dstPort"),
            "connection_info.protocol_name": _of("proto", "lower"),
            **_traffic(bytes_out="srcBytes", bytes_in="dstBytes", packets_out="srcPackets", packets_in="dstPackets"),
            "device.hostname": "devName",
        }
    },
)

CEF = Source(
    id="cef.generic_firewall",
    priority=30,
    match=[("contains", "CEF:")],
    kind="cef",
    framing="syslog",
    otherwise="network_activity",
    classes={
        "network_activity": {
            "activity_id": TRAFFIC,
            "time": _of("rt", "int", "epoch_ms"),
            "severity_id": _table("cef.severity", TEN_POINT_SEVERITY, 0),
            **_acted(_table("act", VERDICTS, 0, "lower")),
            **_ends("src", "spt", "dst", "dpt"),
            "src_endpoint.interface_name": "deviceInboundInterface",
            "dst_endpoint.interface_name": "deviceOutboundInterface",
            "connection_info.protocol_name": _of("proto", "lower"),
            **_traffic(bytes_out="in", bytes_in="out"),
            "device.hostname": "dvchost",
        }
    },
)

_transport = {"field": "protocol", "cases": {"tcp": {"columns": "srcport dstport datalen tcpflags seq ack window urg options".split()}, "udp": {"columns": "srcport dstport datalen".split()}, "icmp": {"columns": "icmp_type icmp_a icmp_b icmp_c".split()}}}
_passed = _table("action", {"pass": 1, "block": 2, "reject": 2}, 0)
PFSENSE = Source(
    id="pfsense.filterlog",
    match=[("contains", "filterlog")],
    kind="csv",
    framing="syslog",
    options={
        "columns": "rule subrule anchor tracker interface reason action direction ip_version".split(),
        "branch": {"field": "ip_version", "cases": {"4": {"columns": "tos ecn ttl id offset ipflags protocol_id protocol length src dst".split(), "branch": _transport}, "6": {"columns": "class flow_label hop_limit protocol protocol_id length src dst".split(), "branch": _transport}}},
    },
    otherwise="network_activity",
    classes={
        "network_activity": {
            **_syslog,
            "activity_id": TRAFFIC,
            "severity_id": _passed,
            **_acted(_passed),
            **_ends("src", "srcport", "dst", "dstport"),
            "src_endpoint.interface_name": {"when": "direction", "eq": "in", "then": "interface"},
            "dst_endpoint.interface_name": {"when": "direction", "eq": "out", "then": "interface"},
            "connection_info.protocol_num": _of("protocol_id", "int"),
            "connection_info.protocol_name": _of("protocol", "lower"),
        }
    },
)

ALL = [FORTIGATE, ASA, SURICATA, SQUID, ZEEK, WINDOWS, DNSMASQ, LEEF, CEF, PFSENSE]
