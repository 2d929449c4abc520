"""Sources described as data: how a line is recognised, extracted and mapped to the event schema.

A :class:`Source` is compiled to columns, so one ``select`` turns lines into events. Expressions are plain Python values:
a string names a field; ``{"const": v}``; ``{"from": field or [fields], "pipe": [...], "default": v}``, where a list is
joined by a leading ``("concat", separator)`` and ``strptime`` may take its zone from a field (``tz_from``);
``{"coalesce": [...], "default": v}``; ``{"when": field, "eq": v, "then": e, "else": e}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pipes
from ..functions.text import java_pattern, literal
from ..schema import CATEGORIES, CLASSES
from .extract import EXTRACTORS, tsv_with_header


def _field(fields: Column, name: str) -> Column:
    """A field's text; empty counts as absent."""
    return F.nullif(fields[name], F.lit(""))


def references(expr) -> set[str]:
    """Every field that an expression names, in branches that aren't taken too."""
    if isinstance(expr, str):
        return {expr}
    if "from" in expr:
        zones = {op[1]["tz_from"] for op in expr.get("pipe", []) if not isinstance(op, str) and op[0] == "strptime" and "tz_from" in op[1]}
        return zones.union([expr["from"]] if isinstance(expr["from"], str) else expr["from"])
    if "coalesce" in expr:
        return set().union(*map(references, expr["coalesce"]))
    if "when" in expr:
        return {expr["when"]}.union(*[references(expr[k]) for k in ("then", "else") if k in expr])
    return set()


def _zoned(fields: Column, op):
    """An operation with the zone that it takes from a field; an absent or empty one is UTC."""
    if isinstance(op, str) or op[0] != "strptime" or "tz_from" not in op[1]:
        return op
    if "tz" in op[1]:
        raise ValueError("strptime takes tz or tz_from, not both")
    return "strptime", {"fmt": op[1]["fmt"], "tz": F.coalesce(_field(fields, op[1]["tz_from"]), F.lit("UTC"))}


def evaluate(fields: Column, expr) -> Column:
    """An expression as a column. A list ``from`` is null if any member is; ``when`` compares the raw text, empty or not."""
    if isinstance(expr, str):
        return _field(fields, expr)
    if "const" in expr:
        return F.lit(expr["const"])
    if "coalesce" in expr:
        found = F.coalesce(*[evaluate(fields, e) for e in expr["coalesce"]])
    elif "when" in expr:
        branch = evaluate(fields, expr["then"])
        other = evaluate(fields, expr["else"]) if "else" in expr else F.lit(None)
        return F.when(fields[expr["when"]] == F.lit(str(expr["eq"])), branch).otherwise(other)
    else:
        names, pipe = expr["from"], list(expr.get("pipe", []))
        if isinstance(names, str):
            value = _field(fields, names)
        else:
            sep = ""
            if pipe and not isinstance(pipe[0], str) and pipe[0][0] == "concat":
                sep = pipe.pop(0)[1]
            present = reduce(lambda a, b: a & b, [_field(fields, n).isNotNull() for n in names])
            value = F.when(present, F.concat_ws(sep, *[fields[n] for n in names]))
        found = pipes.apply(value, [_zoned(fields, op) for op in pipe])
    return F.coalesce(found, F.lit(expr["default"])) if "default" in expr else found


_TESTS = {"contains": lambda line, v: line.contains(v), "starts_with": lambda line, v: line.startswith(v), "regex": lambda line, v: F.substring(line, 1, 1 << 16).rlike(java_pattern(v)[0])}


def _of_fields(predicate: tuple) -> bool:
    return predicate[0] == "field_eq" or predicate[0] == "any" and any(map(_of_fields, predicate[1]))


def _held(predicate: tuple, line: Column, fields: Column | None) -> Column:
    if predicate[0] == "any":
        return reduce(lambda a, b: a | b, [_held(p, line, fields) for p in predicate[1]])
    if predicate[0] == "field_eq":
        return F.coalesce(fields[predicate[1]] == F.lit(str(predicate[2])), F.lit(False))
    return _TESTS[predicate[0]](line, predicate[1])


@dataclass
class Source:
    """``match``: predicates that must all hold: ``(kind, value)`` of the raw line, ``("field_eq", field, value)`` of a field
    once it is extracted, or ``("any", [predicates])``. ``select``: (field, value, class) rules, tried in order, then
    ``otherwise``. ``classes``: for each class, setters from dotted path to expression. A source without predicates takes
    no line."""

    id: str
    match: list[tuple]
    kind: str
    options: dict = field(default_factory=dict)
    select: list[tuple[str, str, str]] = field(default_factory=list)
    otherwise: str = "base_event"
    classes: dict[str, dict] = field(default_factory=dict)
    ignore: dict[str, str] = field(default_factory=dict)
    framing: str = "none"
    priority: int = 50
    version: str = "1"

    def matches(self, line: Column) -> Column:
        """Whether the line may be of this source, as far as can be told before it is extracted."""
        held = [_held(p, line, None) for p in self.match if not _of_fields(p)]
        return reduce(lambda a, b: a & b, held) if held else F.lit(bool(self.match))

    def confirms(self, line: Column, fields: Column) -> Column | None:
        """Predicates that need the fields; None if there are none."""
        held = [_held(p, line, fields) for p in self.match if _of_fields(p)]
        return reduce(lambda a, b: a & b, held) if held else None

    def extract(self, line: Column, head: Column, header: Column | None = None) -> Column:
        """Fields of the line. With ``framing="syslog"`` those of the message after its header, and ``syslog.host`` and
        ``syslog.time_ms``, which count neither for coverage nor as unmapped. ``head`` is the line's header as
        :func:`.extract.syslog` reads it, once for all sources. ``header``: names and marks that hold for a line of
        separated cells (see :mod:`..streaming.headers`)."""
        if self.kind == "tsv" and header is not None:
            return tsv_with_header(line, header, **self.options)
        if self.framing != "syslog":
            return EXTRACTORS[self.kind](line, **self.options)
        found = EXTRACTORS[self.kind](head["message"], **self.options)
        context = F.create_map(F.lit("syslog.host"), head["host"], F.lit("syslog.time_ms"), head["time_ms"].cast("string"), F.lit("syslog.assumed"), F.when(head["assumed"], "true"))
        return F.map_concat(found, F.map_filter(context, lambda k, v: v.isNotNull() & ~F.map_contains_key(found, k)))

    def class_of(self, fields: Column) -> Column:
        return pipes.choose([(fields[name] == value, F.lit(cls)) for name, value, cls in self.select], F.lit(self.otherwise))


def _tree(setters: dict[str, Column]) -> Column:
    """A struct from dotted paths."""
    groups: dict[str, dict | Column] = {}
    for path, column in setters.items():
        head, _, rest = path.partition(".")
        if rest:
            groups.setdefault(head, {})[rest] = column
        else:
            groups[head] = column
    return F.struct(*[(_tree(v) if isinstance(v, dict) else v).alias(k) for k, v in groups.items()])


#: Paths that the lake's columns come from, with their types.
_TYPED = {"time": "long", "activity_id": "int", "severity_id": "int", "action_id": "int", "src_endpoint.port": "int", "dst_endpoint.port": "int", "connection_info.protocol_num": "int", "http_response.code": "int", "traffic.bytes_in": "long", "traffic.bytes_out": "long", "traffic.packets_in": "long", "traffic.packets_out": "long", "duration": "long"}
_GOLD_PATHS = {"src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port", "proto_name": "connection_info.protocol_name", "proto_num": "connection_info.protocol_num", "bytes_in": "traffic.bytes_in", "bytes_out": "traffic.bytes_out", "packets_in": "traffic.packets_in", "packets_out": "traffic.packets_out", "duration_ms": "duration", "url": "http_request.url.text", "http_method": "http_request.http_method", "http_status": "http_response.code", "dns_query": "query.hostname", "signature": "finding_info.title", "device_host": "device.hostname"}


#: Names the form of the stored rows.
LAKE_SCHEMA = "eventlake-1"
#: The name under which a line's source travels with its fields.
PACK = "\x00pack"


def _own(keys: Column) -> Column:
    """Names of fields that the line itself holds."""
    return F.filter(keys, lambda k: ~k.startswith("syslog.") & (k != PACK))


def set_values(found: DataFrame, sources: list[Source]) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """``found`` with a struct of what the setters of each row's kind give, and where in it each kind's paths are.

    Setters of one path and type share a place, whatever their kind: a row evaluates those of its own kind, once, and all
    that follows reads them from the struct. Kinds are told apart by number, which is a cheap comparison.
    """
    f = F.col("fields")
    kinds = {f"{s.id}|{c}": {p: evaluate(f, e) for p, e in expr.items()} for s in sources for c, expr in s.classes.items()}
    flat = [(k, p, column) for k, own in kinds.items() for p, column in own.items()]
    types = found.select(*[column.alias(str(i)) for i, (_, _, column) in enumerate(flat)]).schema
    places: dict[tuple[str, str], list[tuple[str, Column]]] = {}
    for (k, p, column), t in zip(flat, types, strict=True):
        places.setdefault((p, t.dataType.simpleString()), []).append((k, column))
    number = {k: i for i, k in enumerate(kinds)}
    found = once(found, "__kind", pipes.lookup(F.col("kind"), number).cast("int"))
    at: dict[str, dict[str, Column]] = {k: {} for k in kinds}
    made = []
    for i, ((p, t), held) in enumerate(places.items()):
        for k, _ in held:
            at[k][p] = F.col(f"__set.s{i}")
        made.append(pipes.choose([(F.col("__kind") == number[k], column) for k, column in held]).alias(f"s{i}"))
    # In the order of each kind's own setters, which is that of its event.
    return once(found, "__set", F.struct(*made)), {k: {p: at[k][p] for p in own} for k, own in kinds.items()}


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often what follows names it.

    Spark would copy the expression into each use; a generator of one row is a boundary that it doesn't move code across.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def map_events(found: DataFrame, sources: list[Source]) -> tuple[DataFrame, dict[str, Column]]:
    """The lake's columns of lines with ``fields`` and ``kind`` (source and class), for all sources, and the rows that they
    are columns of. Without a valid time a row has its receive time and is partial.
    """
    f, kind = F.col("fields"), F.col("kind")
    exprs = {f"{s.id}|{c}": expr for s in sources for c, expr in s.classes.items()}
    found, setters = set_values(found, sources)

    def case(values: dict[str, Column], sql_type: str) -> Column:
        """Of each row's kind; kinds with the same column are one branch."""
        return pipes.choose([(F.col("__kind") == i, values[k]) for i, k in enumerate(setters) if k in values]).cast(sql_type)

    def path(p: str) -> Column:
        t = _TYPED.get(p, "string")
        places = {str(own[p]): own[p] for own in setters.values() if p in own}
        # A row has a value in the place of its own kind alone.
        return F.coalesce(*[c.try_cast(t) for c in places.values()]) if places else F.lit(None).cast(t)

    def used(k: str) -> Column:
        """Fields consumed: those that a setter with a value names anywhere."""
        each = [F.when(column.isNotNull(), _texts(references(exprs[k][p]))).otherwise(none) for p, column in setters[k].items() if references(exprs[k][p])]
        return F.array_distinct(F.concat(*each)) if each else none

    none = F.array().cast("array<string>")
    found = once(found, "__use", F.struct(case({k: used(k) for k in setters}, "array<string>").alias("consumed"), _own(F.map_keys(f)).alias("keys")))
    consumed, keys = F.col("__use.consumed"), F.col("__use.keys")
    ignored = {f"{s.id}|{c}": s.ignore for s in sources for c in s.classes}
    dropped = case({k: _texts(v) for k, v in ignored.items() if v}, "array<string>")
    left = F.array_except(keys, F.concat(F.coalesce(consumed, none), F.coalesce(dropped, none)))
    class_uid = pipes.lookup(F.split_part(kind, F.lit("|"), F.lit(2)), CLASSES).cast("int")
    at = path("time")
    coverage = F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.bround(F.size(F.array_intersect(keys, consumed)) / F.size(keys), 4))
    status = F.when(at.isNull(), "partial").otherwise("parsed")
    source_id = F.split_part(kind, F.lit("|"), F.lit(1))
    reasons = {f"{name}": why for s in sources for name, why in s.ignore.items()}
    hit = F.array_intersect(keys, F.coalesce(dropped, none))
    lineage = F.struct(
        F.concat("raw_id", F.lit(":0")).alias("event_id"), F.col("raw_ref"), F.col("raw_sha256"), F.col("recv_ms").alias("recv_time"), source_id.alias("source_id"),
        case({f"{s.id}|{c}": F.lit(s.version) for s in sources for c in s.classes}, "string").alias("pack_version"), F.lit(LAKE_SCHEMA).alias("schema"), status.alias("status"), coverage.alias("coverage"),
        F.when(at.isNull(), "recv_time").when(f["syslog.assumed"] == "true", "assumed").otherwise("source_tz").alias("time_quality"),
        F.when(F.size(hit) > 0, F.map_from_arrays(hit, F.transform(hit, lambda k: pipes.lookup(k, reasons)))).alias("ignored"),
    )
    columns = {
        "event_id": F.concat("raw_id", F.lit(":0")),
        "raw_ref": F.col("raw_ref"),
        "raw_sha256": F.col("raw_sha256"),
        "time": F.timestamp_millis(F.coalesce(at, "recv_ms")),
        "recv_time": F.timestamp_millis("recv_ms"),
        "class_uid": class_uid,
        "status": status,
        "source_id": source_id,
        "user_name": F.coalesce(F.nullif(path("user.name"), F.lit("")), path("actor.user.name")),
        "coverage": coverage.cast("float"),
        "unmapped": F.to_json(F.map_from_arrays(left, F.transform(left, lambda k: f[k]))),
        "event": case({k: F.to_json(_event(own, CLASSES[k.rpartition("|")[2]], lineage)) for k, own in setters.items()}, "string"),
    }
    return found, columns | {p: path(p) for p in ("activity_id", "severity_id", "action_id")} | {g: path(p) for g, p in _GOLD_PATHS.items()}


def _texts(names) -> Column:
    """A literal array of texts."""
    return F.expr(f"array({', '.join(literal(n) for n in sorted(names))})").cast("array<string>")


def _event(own: dict[str, Column], class_uid: int, lineage: Column) -> Column:
    """The document of one event: what its setters give, its class, category and type, and where it comes from."""
    uid = F.lit(class_uid)
    activity = own.get("activity_id", F.lit(None)).try_cast("int")
    fixed = {"class_uid": uid, "category_uid": category_uid(uid), "type_uid": type_uid(uid, activity)}
    return _tree({**own, **fixed, "lineage": lineage})


def type_uid(class_uid: Column, activity_id: Column) -> Column:
    return class_uid * 100 + F.coalesce(activity_id, F.lit(0))


def category_uid(class_uid: Column) -> Column:
    return pipes.lookup(class_uid, CATEGORIES, 0)
