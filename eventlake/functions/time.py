"""Times as epoch milliseconds. Text that is no valid time gives null; no function raises on data."""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, matched

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?$"


def to_timestamp(ts: Column) -> Column:
    """A timestamp with or without zone as one with; without, it is UTC (the session's zone)."""
    return ts.cast("timestamp")


def millis(ts: Column) -> Column:
    return F.unix_millis(to_timestamp(ts))


def bucket(ms: Column, step: int) -> Column:
    """The start of the step that holds ``ms``; rounds down for times before 1970 as well."""
    return (F.floor(ms / step) * step).cast("long")


def iso8601(text: Column) -> Column:
    """Milliseconds of an ISO 8601 time, cut (not rounded) to milliseconds; without zone it is UTC."""
    fixed = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(ISO), F.unix_millis(F.try_to_timestamp(fixed)))


def epoch(value: Column, unit: str) -> Column:
    """Milliseconds from epoch seconds (with fraction, half to even), milliseconds or nanoseconds (rounded down)."""
    if unit == "s":
        return F.bround(value.try_cast("double") * 1000).try_cast("long")
    if unit == "ms":
        return value.try_cast("decimal(38,9)").try_cast("long")
    return F.floor(value.try_cast("decimal(38,0)") / 1_000_000).try_cast("long")


def hms(text: Column) -> Column:
    """Milliseconds of ``h:mm:ss``, minutes and seconds under 60."""
    h, m, s = (F.split_part(text, F.lit(":"), F.lit(i)).try_cast("long") for i in (1, 2, 3))
    return F.when(text.rlike(r"^\d+:[0-5]?\d:[0-5]?\d$"), ((h * 60 + m) * 60 + s) * 1000)


_PARTS = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "H": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "b": r"([A-Za-z]{3})"}


def strptime(text: Column, fmt: str, zone: str | Column = "UTC") -> Column:
    """Milliseconds of ``text`` in a strptime format of %Y %y %m %d %H %M %S %b; runs of blanks match any white space.

    The time is of ``zone``, a name, an offset or a column of either; null where the zone is none (``Area/City`` of the
    time zone database, UTC, Z, GMT or an offset).
    """
    pattern, order, at = "", [], 0
    while at < len(fmt):
        if fmt[at] == "%":
            if fmt[at + 1] not in _PARTS:
                raise ValueError(f"unknown directive %{fmt[at + 1]}")
            pattern += _PARTS[fmt[at + 1]]
            order.append(fmt[at + 1])
            at += 2
        elif fmt[at].isspace():
            pattern += r"\s+"
            while at < len(fmt) and fmt[at].isspace():
                at += 1
        else:
            pattern += re.escape(fmt[at])
            at += 1
    pattern = f"^{pattern}$"
    zoned = not (isinstance(zone, str) and zone == "UTC")
    zone = F.lit(zone) if isinstance(zone, str) else zone
    # One text of all names, as a list of some hundred literals would make every plan large.
    places = " ".join(["", *sorted(z for z in zoneinfo.available_timezones() if re.fullmatch(r"[A-Z][A-Za-z_]+/[A-Za-z_/+-]+", z)), ""])

    def read(found: Column) -> Column:
        part = {d: found[i + 1] for i, d in enumerate(order)}
        number = {d: c.try_cast("int") for d, c in part.items() if d != "b"}
        year = number.get("Y", F.when(number["y"] < 69, number["y"] + 2000).otherwise(number["y"] + 1900) if "y" in number else F.lit(1900))
        month = number.get("m", F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part["b"])).cast("int") if "b" in part else F.lit(1))
        second = number.get("S", F.lit(0))
        made = F.try_make_timestamp(year, month, number.get("d", F.lit(1)), number.get("H", F.lit(0)), number.get("M", F.lit(0)), second, F.lit("UTC"))
        return F.when(second < 60, bound(zone, lambda z: elsewhere(made, z)) if zoned else made)

    def elsewhere(made: Column, zone: Column) -> Column:
        named = zone.rlike(r"^(?:UTC|GMT|Z|[+-](?:0\d|1[0-7]):?[0-5]\d)$") | (zone.contains("/") & F.lit(places).contains(F.concat(F.lit(" "), zone, F.lit(" "))))
        return F.when(named, F.to_utc_timestamp(made, F.when(named, F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")).otherwise("UTC")))

    return F.unix_millis(bound(bound(text, lambda said: matched(said, pattern, len(order))), read))


def uuid7_millis(event_id: Column) -> Column:
    """The time in a UUIDv7: its first 48 bits."""
    digits = F.substring(F.replace(event_id, F.lit("-"), F.lit("")), 1, 12)
    return F.when(event_id.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7"), F.conv(digits, 16, 10).cast("long"))


def uuid7(ms: Column, seed: Column) -> Column:
    """A version 7 UUID of the time ``ms``; the other bits are a hash of ``seed``, so a replay gives the same id."""
    t, r = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.sha2(seed, 256)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(r, 4, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(r, 1, 3), F.lit("-"), variant, F.substring(r, 5, 3), F.lit("-"), F.substring(r, 8, 12))
