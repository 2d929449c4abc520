"""The closed set of value operations that a source's mapping may use, each from column to column.

A pipe is a list of operations; each is a name or ``(name, argument)``. A value that an operation can't take becomes null and
stays null, so a mapping's default applies.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PROTOCOLS
from . import net, text, time


def to_int(value: Column) -> Column:
    """Whole numbers in base 10; a fraction as text is no number."""
    return F.regexp_extract(value.cast("string"), r"(?U)\A\s*([+-]?[0-9]+)\s*\z", 1).try_cast("long")


def lookup(value: Column, table: dict, default=None) -> Column:
    """A value of a small literal table, by the text of the key; the table is one literal of the plan."""
    if not table:
        return F.when(value.isNotNull(), F.lit(default))
    found = F.expr(f"map({', '.join(text.literal(x) for k, v in table.items() for x in (str(k), v))})")[value.cast("string")]
    return found if default is None else F.when(value.isNotNull(), F.coalesce(found, F.lit(default)))


def choose(branches: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """One flat ``CASE``; branches inside branches would be code inside code."""
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    if out is None:
        return F.lit(None) if default is None else default
    return out if default is None else out.otherwise(default)


def piece(value: Column, sep: str, index: int) -> Column:
    """One piece of a split, counted from 0, or from the end if negative; null outside."""
    return F.try_element_at(F.split(value, re.escape(sep), -1), F.lit(index + 1 if index >= 0 else index))


def group(value: Column, pattern: str, which: int | str = 1) -> Column:
    """A group of the first match of a Python pattern; null without match or if the group took no part."""
    java, names = text.java_pattern(pattern)
    found = F.regexp_extract(value, java, names[which] if isinstance(which, str) else which)
    return F.when(value.rlike(java), F.nullif(found, F.lit("")))


OPS: dict[str, Callable[..., Column]] = {
    "str": lambda v: v.cast("string"),
    "int": to_int,
    "float": lambda v: v.try_cast("double"),
    "lower": F.lower,
    "upper": F.upper,
    "strip": text.strip,
    "ip": net.ip,
    "ipv4": lambda v: net.ip(v, v6=False),
    "port": net.port,
    "mac": net.mac,
    "epoch_s": lambda v: time.epoch(v, "s"),
    "epoch_ms": lambda v: time.epoch(v, "ms"),
    "epoch_ns": lambda v: time.epoch(v, "ns"),
    "iso8601": time.iso8601,
    "strptime": lambda v, a: time.strptime(v, a["fmt"], a.get("tz", "UTC")),
    "lookup": lambda v, a: lookup(v, a["map"], a.get("default")),
    "regex": lambda v, a: group(v, a["pattern"], a.get("group", 1)),
    "split": lambda v, a: piece(v, a["sep"], a["index"]),
    "whole": lambda v: v.try_cast("long"),
    "mul": lambda v, a: v * F.lit(a),
    "proto_name": lambda v: lookup(v, PROTOCOLS),
    "hms": time.hms,
}


def apply(value: Column, pipe: list) -> Column:
    for op in pipe:
        name, args = (op, ()) if isinstance(op, str) else (op[0], op[1:])
        if name not in OPS:
            raise ValueError(f"unknown operation: {name}")
        value = OPS[name](value, *args)
    return value
