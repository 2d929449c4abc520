"""Extractors: a line of text to a map of its fields, as columns.

Each returns ``map<string, string>``, or null where the line is not of the format. Repeated names get a suffix (``k``,
``k_2``, ``k_3``). Everything is extracted; what becomes of the fields is decided by the mapping. Lines longer than 64 Ki
characters are cut first, but for JSON and XML, whose documents are read whole, since a part of one is none. Only nested documents (JSON flattening, XML) leave the JVM, in Arrow batches.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, java_pattern, matched

#: Characters of a line that are read, but for JSON and XML.
LONGEST = 1 << 16
_MAP = "map<string,string>"
_MAP_TYPE = T.MapType(T.StringType(), T.StringType())


def cut(line: Column) -> Column:
    return F.substring(line, 1, LONGEST)


def to_map(names: Column, values: Column) -> Column:
    """Parallel arrays as a map; a name that occurs again is numbered from 2 on, and null values are left out."""

    def number(names: Column) -> Column:
        before = lambda n, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == n))
        return F.transform(names, lambda n, i: F.when(before(n, i) == 0, n).otherwise(F.concat(n, F.lit("_"), (before(n, i) + 1).cast("string"))))

    def mapped(pair: Column) -> Column:
        # Only lines that do repeat a name pay for numbering.
        keys = F.when(F.size(F.array_distinct(pair["n"])) == F.size(pair["n"]), pair["n"]).otherwise(number(pair["n"]))
        return F.map_from_arrays(keys, pair["v"])

    return F.map_filter(bound(F.struct(names.alias("n"), values.alias("v")), mapped), lambda k, v: v.isNotNull())


def _after(pair: Column) -> Column:
    return F.substring(pair, F.instr(pair, "=") + 1, F.lit(LONGEST))


def kv(line: Column) -> Column:
    """``key=value`` pairs separated by spaces; a value in double quotes may hold spaces and escaped quotes."""
    pattern = r'[^\s="]++=(?:"(?:[^"\\]|\\.)*+"?+|[^ ]*+)'

    def value(raw: Column) -> Column:
        # Only values with a backslash pay for undoing it.
        plain = F.substring(raw, 2, F.length(raw) - F.when((F.length(raw) > 1) & raw.endswith('"'), 2).otherwise(1))
        escaped = F.regexp_replace(F.regexp_replace(raw, r'^"|(?<!\\)"$', ""), r"\\(.)", "$1")
        return F.when(~raw.startswith('"'), raw).when(raw.contains("\\"), escaped).otherwise(plain)

    def mapped(pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
        raw = F.transform(pairs, _after)
        return F.when(F.size(pairs) > 0, to_map(names, F.transform(raw, value)))

    return bound(F.regexp_extract_all(cut(line), F.lit(pattern), F.lit(0)), mapped)


def regex(line: Column, pattern: str, anchored: bool = True) -> Column:
    """The named groups of a Python pattern. A group that took no part, or is empty, is absent."""
    java, names = java_pattern(pattern)
    java = java if not anchored or java.startswith("(?d)^") else java.replace("(?d)", "(?d)^", 1)

    def mapped(found: Column) -> Column:
        fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[found[i] for i in names.values()]))
        return F.when(found.isNotNull(), F.map_filter(fields, lambda k, v: v != ""))

    return bound(bound(cut(line), lambda text: matched(text, java, re.compile(pattern).groups)), mapped)


def dispatch(line: Column, anchor: str, on: str, text: str, patterns: dict[str, str]) -> Column:
    """Fields of ``anchor``, and of the pattern that its field ``on`` selects, applied to its field ``text``."""
    keys: dict[str, list[str]] = {}
    for key, pattern in patterns.items():
        keys.setdefault(pattern, []).append(key)

    def joined(head: Column) -> Column:
        rest = F.create_map().cast(_MAP)
        for pattern, own in keys.items():
            rest = F.when(head[on].isin(*own), F.coalesce(regex(head[text], pattern), F.create_map().cast(_MAP))).otherwise(rest)
        return F.when(head.isNotNull(), F.map_concat(head, F.map_filter(rest, lambda k, v: ~F.map_contains_key(head, k))))

    # Bound, as each field that is named would match the line anew.
    return bound(regex(line, anchor), joined)


def _layouts(columns: list[str], branch: dict | None, held: list[tuple[int, str]]):
    """Every list of column names that branches lead to, with the cells (by place) that must hold what; defaults last."""
    if branch is None:
        yield columns, held
        return
    at = columns.index(branch["field"])
    for value, case in branch["cases"].items():
        yield from _layouts(columns + case["columns"], case.get("branch"), [*held, (at, value)])
    default = branch.get("default", {"columns": []})
    yield from _layouts(columns + default["columns"], default.get("branch"), held)


def csv(line: Column, columns: list[str], sep: str = ",", branch: dict | None = None) -> Column:
    """Cells by position, with quotes; empty cells are absent, cells beyond the columns are joined as ``_extra``.

    ``branch``: ``{"field": f, "cases": {value: {"columns": [...], "branch": ...}}, "default": ...}`` goes on with other
    columns by the value of a cell, whatever its case.
    """
    line = cut(line)
    layouts = list(_layouts(columns, branch, []))
    width = max(len(c) for c, _ in layouts) + 32
    parsed = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"sep": sep, "mode": "PERMISSIVE"})

    asked = sorted({at for _, held in layouts for at, _ in held})

    def named(cells: Column) -> Column:
        return bound(F.array(*[F.lower(cells[f"c{at}"]) for at in asked]).cast("array<string>"), lambda low: laid(cells, low))

    def laid(cells: Column, low: Column) -> Column:
        out = F.lit(None).cast(_MAP)
        for names, held in reversed(layouts):
            extra = F.concat_ws(sep, *[cells[f"c{i}"] for i in range(len(names), width)])
            values = F.array(*[cells[f"c{i}"] for i in range(len(names))], F.nullif(extra, F.lit("")))
            fits = F.lit(True)
            for at, value in held:
                fits = fits & (low[asked.index(at)] == value.lower())
            out = F.when(fits, F.map_from_arrays(F.array(*[F.lit(c) for c in [*names, "_extra"]]), values)).otherwise(out)
        return out

    # Bound, as the optimiser would make a parser of each cell that is named: hundreds, with a buffer of 2 MB each.
    return F.when(line.contains(sep) & ~line.contains("\r"), F.map_filter(bound(parsed, named), lambda k, v: v.isNotNull() & (v != "")))


# Names of the header fields of the two formats.
CEF_HEADER = ("cef.version", "cef.vendor", "cef.product", "cef.device_version", "cef.signature_id", "cef.name", "cef.severity")
LEEF_HEADER = ("leef.version", "leef.vendor", "leef.product", "leef.product_version", "leef.event_id")


def cef(line: Column) -> Column:
    """ArcSight's common event format: seven header fields divided by bars, then ``key=value`` with spaces in values."""
    cell = r"((?:[^|\\]|\\.)*)"
    pattern = r"(?s)CEF:(\d+)" + (r"\|" + cell) * 6 + r"\|(.*)$"

    def value(raw: Column) -> Column:
        # Only values with a backslash pay for undoing it.
        return F.when(raw.contains("\\"), F.regexp_replace(F.regexp_replace(raw, r"\\([=|\\])", "$1"), r"\\n", "\n")).otherwise(raw)

    def mapped(found: Column) -> Column:
        head = F.transform(F.slice(found, 2, 7), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
        pairs = F.filter(F.split(found[8], r"\s+(?=[\w.\-\[\]]+=)"), lambda p: p.contains("="))
        return bound(pairs, lambda each: named(head, each))

    def named(head: Column, pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: F.trim(F.regexp_extract(p, r"(?s)^\s*([^=]+)=", 1)))
        return to_map(F.concat(F.array(*[F.lit(n) for n in CEF_HEADER]), names), F.concat(head, F.transform(pairs, lambda p: value(_after(p)))))

    return bound(bound(cut(line), lambda text: matched(text, pattern, 8)), lambda found: F.when(found.isNotNull(), mapped(found)))


def leef(line: Column) -> Column:
    """IBM's format: version 1 has tabs between pairs, version 2 names its separator, as a character or in hex."""
    one, two = r"(?s)LEEF:(1[^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", r"(?s)LEEF:(2[^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"

    def mapped(found: Column, said: Column, body: Column) -> Column:
        hexed = F.char(F.conv(F.regexp_extract(said, r"^(?:0x|x)([0-9A-Fa-f]{1,2})$", 1), 16, 10).try_cast("int"))
        sep = F.when(said == "", F.lit("\t")).when(said.rlike(r"^(?:0x|x)[0-9A-Fa-f]{1,2}$"), hexed).otherwise(said)
        pairs = F.filter(F.split(F.replace(body, sep, F.lit("\x00")), "\x00", -1), lambda p: p.contains("="))
        return bound(pairs, lambda each: named(F.slice(found, 2, 5), each))

    def named(head: Column, pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
        return to_map(F.concat(F.array(*[F.lit(n) for n in LEEF_HEADER]), names), F.concat(head, F.transform(pairs, _after)))

    def either(text: Column) -> Column:
        first = lambda found: F.when(found.isNotNull(), mapped(found, F.lit(""), found[6]))
        second = lambda found: F.when(found.isNotNull(), mapped(found, found[6], found[7])).otherwise(bound(matched(text, one, 6), first))
        return bound(matched(text, two, 7), second)

    return bound(cut(line), either)


def tsv(line: Column, fields: Column | list[str], unset: Column | str = "-", empty: Column | str = "(empty)", sep: Column | str = "\t") -> Column:
    """Cells named by ``fields``, divided by ``sep``; unset and empty cells are absent, further cells are ``_extra``.

    Names, marks and separator may be columns, as headers give them. A name that occurs again is numbered.
    """
    line = cut(line)
    unset, empty, sep = (F.lit(x) if isinstance(x, str) else x for x in (unset, empty, sep))
    names = F.array(*[F.lit(f) for f in fields]) if isinstance(fields, list) else fields
    n = F.size(names)

    def named(cells: Column) -> Column:
        extra = F.call_function("array_join", F.slice(cells, n + 1, F.greatest(F.size(cells) - n, F.lit(0))), sep)
        padded = F.concat(F.slice(cells, F.lit(1), n), F.array_repeat(F.lit(None).cast("string"), F.greatest(n - F.size(cells), F.lit(0)).cast("int")))
        # Names given as a list differ; only those of headers may have to be numbered.
        mapped = F.map_from_arrays if isinstance(fields, list) else to_map
        return mapped(F.concat(names, F.array(F.lit("_extra"))), F.concat(padded, F.array(extra)))

    found = bound(F.split(line, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1), named)
    return F.when(line.contains(sep) & ~line.startswith("#"), F.map_filter(found, lambda k, v: v.isNotNull() & (v != unset) & (v != empty) & (v != "")))


def tsv_with_header(line: Column, header: Column, fields: list[str] | None = None, unset: str = "-", empty: str = "(empty)") -> Column:
    """:func:`tsv` by a ``header`` (struct of fields, unset, empty and sep), or by what is given where it has no fields."""
    known = header["fields"].isNotNull()
    pick = lambda name, value: F.when(known, header[name]).otherwise(F.lit(value))
    names = F.when(known, header["fields"]).otherwise(F.array(*[F.lit(f) for f in fields or []]).cast("array<string>"))
    return tsv(line, names, pick("unset", unset), pick("empty", empty), pick("sep", "\t"))


def _flat(value, path: str, out: dict) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(v, f"{path}.{k}" if path else str(k), out)
    elif value is not None:
        out[path] = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(_MAP_TYPE)
def _json_map(lines: pd.Series) -> pd.Series:
    def one(line):
        try:
            document = json.loads(line)
        except (ValueError, RecursionError):
            return None
        if not isinstance(document, dict):
            return None
        out: dict = {}
        _flat(document, "", out)
        return out

    return lines.map(one, na_action="ignore")


def json_fields(line: Column) -> Column:
    """The leaves of a JSON object by dotted path; lists stay as JSON text and empty objects vanish. Lines are read whole."""
    return _json_map(F.when(F.ltrim(line).startswith("{"), line))


@F.pandas_udf(_MAP_TYPE)
def _xml_map(lines: pd.Series) -> pd.Series:
    def walk(node, path, out, depth):
        if depth > 64:
            raise ValueError("too deep")
        for name, value in node.attrib.items():
            out.setdefault(f"{path}.@{name.rpartition('}')[2]}" if path else f"@{name}", value)
        for child in node:
            tag = child.tag.rpartition("}")[2]
            tag = child.attrib.get("Name", tag) if tag == "Data" else tag
            at = f"{path}.{tag}" if path else tag
            if len(child):
                walk(child, at, out, depth + 1)
            else:
                if child.text and child.text.strip():
                    out.setdefault(at, child.text.strip())
                for name, value in child.attrib.items():
                    if name != "Name":
                        out.setdefault(f"{at}.@{name.rpartition('}')[2]}", value)

    def one(line):
        if "<!DOCTYPE" in line or "<!ENTITY" in line:
            return None
        try:
            out: dict = {}
            walk(ET.fromstring(line), "", out, 1)
            return out
        except (ET.ParseError, ValueError):
            return None

    return lines.map(one, na_action="ignore")


def xml(line: Column) -> Column:
    """Leaf elements and attributes by path below the root. Documents with a DOCTYPE or entities are refused unread."""
    return _xml_map(F.when(F.ltrim(line).startswith("<"), line))


_RFC5424 = r"(?s)^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(.*)$"
_RFC3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) (.*)$"


def syslog(line: Column, received_ms: Column) -> Column:
    """struct<message, priority, host, time_ms, assumed>: a syslog header of either kind, or the line as it is.

    An RFC 3164 time has no year: it takes that of ``received_ms``, one less if it were more than two days after it.
    """
    both = lambda text: F.struct(text.alias("line"), matched(text, _RFC5424, 8).alias("new"), matched(text, _RFC3164, 4).alias("old"))
    return bound(bound(line, both), lambda x: _header(x["line"], x["new"], x["old"], received_ms))


def _header(line: Column, new: Column, old: Column, received_ms: Column) -> Column:
    """The struct of :func:`syslog` from a line and its groups under either pattern, null where it doesn't match."""
    priority = F.when(line.startswith("<"), F.regexp_extract(line, r"^<(\d{1,3})>", 1).try_cast("int"))
    stamp = F.unix_millis(F.try_to_timestamp(new[2]))
    year = F.year(F.timestamp_millis(received_ms))
    said = old[2]
    month = F.array_position(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.substring(said, 1, 3)).cast("int")
    clock = [F.substring(said, i, 2).try_cast("int") for i in (8, 11, 14)]
    made = lambda y: F.unix_millis(F.try_make_timestamp(y, month, F.trim(F.substring(said, 5, 2)).try_cast("int"), *clock, F.lit("UTC")))
    guess = bound(made(year), lambda t: F.when(t > received_ms + 2 * 86_400_000, made(year - 1)).otherwise(t))
    plain = F.when(line.startswith("<"), F.regexp_replace(line, r"^<\d{1,3}>", "")).otherwise(line)
    message = F.when(new.isNotNull(), F.concat(F.when(new[7] != "-", F.concat(new[7], F.lit(" "))).otherwise(""), new[8])).when(old.isNotNull(), old[4]).otherwise(plain)
    message = F.when(new.isNull() & old.isNotNull(), F.regexp_replace(message, r"^[\w./-]+(?:\[\d+\])?: ", "")).otherwise(message)  # the program's tag
    host = F.when(new.isNotNull(), F.nullif(new[3], F.lit("-"))).when(old.isNotNull(), old[3])
    return F.struct(message.alias("message"), priority.alias("priority"), host.alias("host"), F.when(new.isNotNull(), stamp).when(old.isNotNull(), guess).alias("time_ms"), F.when(line.isNotNull(), old.isNotNull()).alias("assumed"))


def sniff(line: Column) -> Column:
    """The format of a line by its first characters: json, xml, cef, leef, syslog, tsv or text."""
    start = F.ltrim(line)
    return (
        F.when(start.startswith("{"), "json")
        .when(start.startswith("<?xml") | start.rlike(r"^<[A-Za-z]"), "xml")
        .when(line.contains("CEF:"), "cef")
        .when(line.contains("LEEF:"), "leef")
        .when(line.rlike(r"^<\d{1,3}>"), "syslog")
        .when(line.contains("\t"), "tsv")
        .otherwise("text")
    )


EXTRACTORS = {"kv": kv, "regex": regex, "dispatch": dispatch, "csv": csv, "cef": cef, "leef": leef, "tsv": tsv, "json": json_fields, "xml": xml}
