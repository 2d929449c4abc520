"""Rules that rows must meet, as one array of the names of those they break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.net import IPV4
from ..functions.text import bound
from ..schema import ACTION_IDS, ACTIVITIES, CATEGORIES, CLASSES, DISPOSITION_IDS, LATEST_MS, SEVERITY_IDS, STATUS_IDS, STATUSES


def violations(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules (name to predicate of a violation) that hold for a row; a null predicate doesn't."""
    found = F.array(*[F.when(rule, F.lit(name)) for name, rule in sorted(rules.items())])
    return F.filter(found, lambda x: x.isNotNull())


def lake_rules() -> dict[str, Column]:
    """What a lake row must meet: identity, known class and status, ports, addresses and coverage in range."""
    c = F.col
    return {
        "event_id_missing": c("event_id").isNull(),
        "class_unknown": ~c("class_uid").isin(*CLASSES.values()),
        "status_unknown": ~c("status").isin(*STATUSES),
        "time_missing": c("time").isNull(),
        "port_range": ~c("src_port").between(0, 65535) | ~c("dst_port").between(0, 65535),
        "ip_invalid": ~(c("src_ip").rlike(IPV4) | c("src_ip").contains(":")) | ~(c("dst_ip").rlike(IPV4) | c("dst_ip").contains(":")),
        "coverage_range": ~c("coverage").between(0, 1),
        "finding_without_title": (c("class_uid") == 2004) & c("signature").isNull(),
    }


#: Paths of the numbers that a valid event has one of.
_ENUMS = {"action_id": ACTION_IDS, "disposition_id": DISPOSITION_IDS, "severity_id": SEVERITY_IDS, "status_id": STATUS_IDS}


#: Paths of the whole numbers that rules compare, and of what they ask for by its text.
_NUMBERS = ("class_uid", "category_uid", "activity_id", "type_uid", "time", *_ENUMS)
_TEXTS = ("lineage", "lineage.status", "finding_info.title", *[f"{end}_endpoint.{p}" for end in ("src", "dst") for p in ("ip", "port")])


def _read(event: Column) -> Column:
    """What all rules ask of a document: its texts by path, null if absent, and numbers, null where they are none."""

    def texts(document: Column) -> list[Column]:
        get = lambda p, t: F.try_variant_get(document, f"$.{p}", t)
        quoted = lambda p: F.schema_of_variant(get(p, "variant")) == "STRING"
        said = [get(p, "string").alias(p) for p in (*_NUMBERS, *_TEXTS)]
        return [*said, *[F.when(~quoted(p), get(p, "string").try_cast("long")).alias(f"number of {p}") for p in _NUMBERS]]

    return bound(F.try_parse_json(event), lambda document: F.struct(*texts(document)))


def event_violations(event: Column) -> Column:
    """The :func:`violations` of :func:`event_rules`; a document is parsed once for all of them."""
    return bound(_read(event), lambda said: violations(_rules(said)))


def event_rules(event: Column) -> dict[str, Column]:
    """What the document of an event must meet, by the path that a violation names.

    Class, category and type must agree, numbers must be of their enumeration, times whole milliseconds, addresses and ports
    valid; a parsed event has a time, and all but base events an activity, findings a title. An event of an unknown class
    breaks that rule alone. Numbers are told from text by their JSON, so "80" is no port.
    """
    return _rules(_read(event))


def _rules(said: Column) -> dict[str, Column]:
    get, number = said.__getitem__, lambda p: said[f"number of {p}"]

    cls, activity = number("class_uid"), F.coalesce(number("activity_id"), F.when(get("activity_id").isNull(), F.lit(0)))
    known = F.coalesce(cls.isin(*CATEGORIES), F.lit(False))
    category, allowed = F.lit(None).cast("int"), F.lit(False)
    for c in CATEGORIES:
        category = F.when(cls == c, F.lit(CATEGORIES[c])).otherwise(category)
        allowed = F.when(cls == c, F.coalesce(activity.isin(*ACTIVITIES[c]), F.lit(False))).otherwise(allowed)
    parsed = get("lineage.status") == "parsed"
    rules = {
        "category_uid": ~number("category_uid").eqNullSafe(category),
        "activity_id": ~allowed,
        "type_uid": allowed & ~number("type_uid").eqNullSafe(cls * 100 + activity),
        "time": ~F.coalesce(number("time").between(0, LATEST_MS), F.lit(False)),
        "lineage": get("lineage").isNull(),
        "lineage.status": ~F.coalesce(get("lineage.status").isin(*STATUSES), F.lit(False)),
        "finding_info.title": (cls == 2004) & parsed & get("finding_info.title").isNull(),
        **{p: get(p).isNotNull() & ~F.coalesce(number(p).isin(*ids), F.lit(False)) for p, ids in _ENUMS.items()},
    }
    for end in ("src_endpoint", "dst_endpoint"):
        ip, port = get(f"{end}.ip"), get(f"{end}.port")
        rules[f"{end}.ip"] = ip.isNotNull() & ~(ip.rlike(IPV4) | ip.contains(":"))
        rules[f"{end}.port"] = port.isNotNull() & ~F.coalesce(port.try_cast("long").between(0, 65535), F.lit(False))
    return {"class_uid": ~known, **{p: known & F.coalesce(rule, F.lit(False)) for p, rule in rules.items()}}
