"""Structured search terms as predicates.

A search is a list of terms that must all hold; a term is a column, an operation and values, any of which may hold. There is
no query text to parse: terms are values, and become Catalyst predicates that reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import in_network
from ..functions.text import like_pattern
from ..schema import ACTIONS, CASE_INSENSITIVE, IP_FIELDS, STATUSES

#: Most terms of a search and values of a term.
MOST_TERMS, MOST_VALUES = 24, 100
_COMPARE = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}


@dataclass(frozen=True)
class Term:
    """``op``: ``=`` (with ``*`` as a wildcard in text, and CIDR for addresses), ``>= <= > <``, ``..`` (values are pairs,
    both ends inside) or ``text`` (anywhere in the column). ``negate`` keeps rows where the value is null."""

    field: str
    values: tuple
    op: str = "="
    negate: bool = False


def millis_of(value) -> int:
    """Epoch milliseconds of a number, a date, or ISO 8601 text (midnight and UTC where it doesn't say)."""
    if isinstance(value, int):
        return value
    when = dt.datetime.fromisoformat(str(value))
    when = when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)
    return int(when.timestamp() * 1000)


def _one(term: Term, value, kind: str) -> Column:
    column = F.col(term.field)
    if term.op == "text":
        return column.ilike(f"%{like_pattern(str(value)).replace('%', chr(92) + '%') if '*' in str(value) else like_pattern(str(value))}%")
    if kind.startswith("timestamp"):
        value = tuple(F.timestamp_millis(F.lit(millis_of(v))) for v in value) if term.op == ".." else F.timestamp_millis(F.lit(millis_of(value)))
        column = column.cast("timestamp")
    if term.op == "..":
        return column.between(*value)
    if term.op in _COMPARE:
        return _COMPARE[term.op](column, value)
    if term.op != "=":
        raise ValueError(f"unknown operation: {term.op}")
    if kind != "string":
        return column == value
    text = str(value)
    if term.field in IP_FIELDS and "/" in text:
        return in_network(column, text)
    if "*" in text:
        return column.ilike(like_pattern(text)) if term.field in CASE_INSENSITIVE else column.like(like_pattern(text))
    if term.field in IP_FIELDS:
        return column == str(ipaddress.ip_address(text))
    return F.lower(column) == text.lower() if term.field in CASE_INSENSITIVE else column == text


def predicate(term: Term, schema) -> Column:
    """A term as a predicate. A plain term is bare, so that it is pushed to the scan: a filter drops null anyway; a
    negated one is two-valued, so that it keeps rows whose value is null."""
    kind = schema[term.field].dataType.simpleString()
    if not term.values or len(term.values) > MOST_VALUES:
        raise ValueError(f"a term has 1 to {MOST_VALUES} values")
    if term.field == "action_id":
        term = Term(term.field, tuple(ACTIONS.get(str(v).lower(), v) for v in term.values), term.op, term.negate)
    if term.field == "status" and not set(term.values) <= set(STATUSES):
        raise ValueError(f"status is one of {', '.join(STATUSES)}")
    plain = term.op == "=" and (kind not in ("string", "timestamp", "timestamp_ntz") or term.field not in IP_FIELDS | CASE_INSENSITIVE and not any("*" in str(v) for v in term.values)) and not kind.startswith("timestamp")
    held = F.col(term.field).isin(*term.values) if plain else reduce(lambda a, b: a | b, [_one(term, v, kind) for v in term.values])
    return ~F.coalesce(held, F.lit(False)) if term.negate else held


def search(df: DataFrame, terms: list[Term]) -> DataFrame:
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    for term in terms:
        df = df.filter(predicate(term, df.schema))
    return df


def time_bounds(df: DataFrame, start=None, end=None, column: str = "time") -> DataFrame:
    """Rows with ``start <= column <= end``, either left out. On a lake with dt and hour they prune partitions too."""
    for value, ge in ((start, True), (end, False)):
        if value is not None:
            at = F.timestamp_millis(F.lit(millis_of(value)))
            df = df.filter(F.col(column) >= at if ge else F.col(column) <= at)
            if {"dt", "hour"} <= set(df.columns):
                day, hour = F.to_date(at), F.hour(at)
                df = df.filter((F.col("dt") > day) | (F.col("dt") == day) & (F.col("hour") >= hour) if ge else (F.col("dt") < day) | (F.col("dt") == day) & (F.col("hour") <= hour))
    return df


def page(df: DataFrame, size: int = 100, after: tuple | None = None, time: str = "time", key: str = "event_id") -> DataFrame:
    """Newest first by (time, key): one page and one row more, which tells whether another page follows.

    ``after``: time and key of the last row seen. The predicate is a range on the order, so no offset is ever skipped.
    """
    if after is not None:
        at = F.lit(after[0]).cast(df.schema[time].dataType)
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < F.lit(after[1]))))
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc_nulls_last()).limit(size + 1)
