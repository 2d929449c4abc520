"""Text as columns: patterns, masks, JSON keys and repair."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX, _OCTET = "[0-9A-Fa-f]", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DATE, _CLOCK = "[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"

#: What becomes a mark in a template, in this order: UUIDs (RFC 4122), times (RFC 3339, with a comma or a space too, and no
#: further than their zone), hardware addresses, IPv4 addresses, hexadecimal numbers, numbers.
MASKS = (
    (rf"\b{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\b", "<UUID>"),
    (rf"\b{_DATE}[T ]{_CLOCK}(?:[.,][0-9]+)?(?:Z\b|[+-][0-9]{{2}}:?[0-9]{{2}}\b)?", "<TS>"),
    (rf"\b{_HEX}{{2}}(?:(?::{_HEX}{{2}}){{5}}|(?:-{_HEX}{{2}}){{5}})\b", "<MAC>"),
    (rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", "<IP>"),
    (rf"\b0[xX]{_HEX}+\b", "<HEX>"),
    (r"\b[0-9]+\b", "<NUM>"),
)


def mask(text: Column) -> Column:
    """``text`` with its variable parts replaced: lines of one template become equal."""
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def strip(text: Column) -> Column:
    """White space (Unicode's) off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it: an array of one binds it."""
    return F.transform(F.array(value), then)[0]


def matched(line: Column, java: str, groups: int) -> Column:
    """The text before the first match of a Java pattern and then its groups, as an array; null without a match.

    One pass for all groups: they are put between marks and split. Text that holds the mark is searched group by group.
    """
    mark = "\x00"
    marked = F.regexp_replace(line, F.lit(java), F.lit(mark + mark.join(f"${i}" for i in range(1, groups + 1)) + mark))
    apart = F.when(line.rlike(java), F.array(F.lit(""), *[F.regexp_extract(line, java, i) for i in range(1, groups + 1)]))
    return F.when(line.contains(mark), apart).otherwise(bound(F.split(marked, mark, -1), lambda found: F.when(F.size(found) > 1, found)))


def like_pattern(wildcard: str) -> str:
    """A LIKE pattern (escape character backslash) in which only ``*`` is a wildcard."""
    return re.sub(r"([\\%_])", r"\\\1", wildcard).replace("*", "%")


def slug(text: Column) -> Column:
    """Lower case with runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def repaired(data: Column) -> Column:
    """Bytes as text, with invalid UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def literal(value) -> str:
    """A Python text or number as SQL writes it."""
    if not isinstance(value, str):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python regular expression for Java, its named groups turned to plain ones, and their numbers."""
    names = dict(re.compile(pattern).groupindex)
    return "(?d)" + re.sub(r"\(\?P<\w+>", "(", pattern), names
