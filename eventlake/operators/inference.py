"""What the fields of an unknown source are: types with their units, and the paths of the event schema that they fit.

All values of all fields are counted once, by (name, value); what follows reads these counts: one row a different value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..session import cut
from .mapping import Source, references

#: Examples shown of a field, and the share of values that must pass a type's test.
EXAMPLES, NEARLY_ALL, MOST_URLS = 5, 0.95, 0.9
# Forms of times as text, in the order in which they are tried, and ranges of epochs by unit.
TIMES = (
    ("iso8601", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?$"),
    ("datetime", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?$"),
    ("syslog_ts", r"^[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d$"),
    ("syslog_ts_year", r"^[A-Z][a-z]{2} +\d{1,2} \d{4} \d\d:\d\d:\d\d$"),
    ("date", r"^\d{4}-\d\d-\d\d$"),
    ("time", r"^\d\d:\d\d:\d\d$"),
)
EPOCHS = (("epoch_s", 10**9), ("epoch_ms", 10**12), ("epoch_ns", 10**18))
#: Names of fields that hold times or ports.
TIME_NAME, TIME_NAME_FLOAT, PORT_NAME = "time|ts|stamp|date|epoch|created|start|end", "time|ts|stamp|date|epoch", "(^|_)(p|port|sport|dport|spt|dpt)$|port"
INT, FLOAT, MAC, URL = r"^-?\d+$", r"^-?\d+\.\d+$", r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$", r"(?i)^(?:[a-z][a-z0-9+.-]*://|www\.)\S+$"


def value_counts(fields: DataFrame, order: str, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value, n, first): how often each field has each value, and the smallest ``order`` among those rows.

    Null and empty values say nothing and are left out, as are rows without a name.
    """
    rows = fields.filter(F.col(name).isNotNull() & (F.col(value) != ""))
    return rows.groupBy(F.col(name).alias("name"), F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def infer_types(counts: DataFrame, rows: int | None = None) -> DataFrame:
    """name, type, unit, support, seen, distinct and examples of every field of :func:`value_counts`.

    Types are tried in this order, each on nearly all values (95 %): ip, mac, timestamp (as text of one of ``TIMES``, or a
    whole number in the range of one of ``EPOCHS``; seconds also need a name that tells a time), port (by name and range),
    int, float, bool, url (90 %), enum (12 values at most, in a quarter of the rows once there are 20), text. ``unit`` is the
    form or the epoch's unit of a timestamp, else null. Ranges are judged over all values that are numbers.

    ``support`` is the share of ``rows`` (lines that were extracted) in which the field is seen, null if that isn't given.
    Examples are the five values that came first. Every count is a partial sum over (name, value): a field that a third of
    all rows share, or a value that all have, is one row a task.
    """
    v, n = F.col("value"), F.col("n")
    number = F.when(v.rlike(INT) | v.rlike(FLOAT), v.try_cast("decimal(38,9)"))
    tests = {"ip": net.ip(F.trim(v)).isNotNull(), "mac": v.rlike(MAC), **{kind: v.rlike(form) for kind, form in TIMES}, "int": v.rlike(INT), "float": v.rlike(INT) | v.rlike(FLOAT), "bool": F.lower(v).isin("true", "false", "yes", "no"), "url": v.rlike(URL)}
    made = counts.groupBy("name").agg(*[F.sum(F.when(test, n).otherwise(0)).alias(f"__{t}") for t, test in tests.items()], F.sum("n").alias("seen"), F.count("*").alias("distinct"), F.min(number).alias("__low"), F.max(number).alias("__high"))
    most = lambda t, share=NEARLY_ALL: F.col(f"__{t}") >= F.col("seen") * share
    within = lambda low, high: F.coalesce((F.col("__low") >= F.lit(low)) & (F.col("__high") < F.lit(high)), F.lit(False))
    named = lambda pattern: F.lower("name").rlike(pattern)
    whole = {unit: most("int") & within(start, 4 * start) & (named(TIME_NAME) if unit == "epoch_s" else F.lit(True)) for unit, start in EPOCHS}
    seconds = most("float") & ~most("int") & within(10**9, 4 * 10**9) & named(TIME_NAME_FLOAT)
    few = (F.col("distinct") <= 12) & ((F.col("seen") < 20) | (F.col("distinct") <= F.col("seen") * 0.25))
    rules: list[tuple[str, str | None, Column]] = [
        ("ip", None, most("ip")), ("mac", None, most("mac")), *[("timestamp", kind, most(kind)) for kind, _ in TIMES], *[("timestamp", unit, held) for unit, held in whole.items()],
        ("port", None, most("int") & named(PORT_NAME) & within(0, 65536)), ("int", None, most("int")), ("timestamp", "epoch_s", seconds), ("float", None, most("float")), ("bool", None, most("bool")), ("url", None, most("url", MOST_URLS)), ("enum", None, few),
    ]
    kind, unit = F.lit("text"), F.lit(None).cast("string")
    for t, u, held in reversed(rules):
        kind, unit = F.when(held, t).otherwise(kind), F.when(held, F.lit(u)).otherwise(unit)
    # The first values of a field: a limit of ranks, which no task exceeds by more than that many rows a field.
    ranked = counts.withColumn("__i", F.row_number().over(Window.partitionBy("name").orderBy("first", "value"))).filter(F.col("__i") <= EXAMPLES)
    shown = ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "value"))), lambda x: x["value"]).alias("examples"))
    support = F.round(F.col("seen") / rows, 6) if rows else F.lit(None).cast("double")
    return made.join(shown, "name").select("name", kind.alias("type"), unit.alias("unit"), support.alias("support"), "seen", "distinct", "examples")


# ---------------------------------------------------------------- paths

#: Values that carry no information.
NULLISH = ("n/a", "na", "none", "null", "-", "unknown", "(null)", "nil")
#: Types that can stand for another one.
KINDRED = (("enum", "text"), ("text", "enum"), ("port", "int"), ("int", "port"), ("int", "float"))


def plain_name(name: Column) -> Column:
    """Letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z]", "")


def aliases(sources: list[Source]) -> list[tuple[str, str]]:
    """(path, field) for each field that one of the sources takes a path from."""
    return sorted({(path, name) for s in sources for setters in s.classes.values() for path, expr in setters.items() for name in references(expr) if not name.startswith("syslog.")})


def known_paths(names: DataFrame, types: DataFrame, path: str = "path", field: str = "field") -> DataFrame:
    """(path, alias, types): what known sources call a path, and which types of values they have there.

    ``names`` is a table of (path, field) such as :func:`aliases`; ``types`` has name and type of those fields.
    """
    joined = names.select(F.col(path).alias("path"), F.col(field).alias("name")).join(types.select("name", "type"), "name", "left")
    kinds = joined.groupBy("path").agg(F.array_compact(F.collect_set("type")).alias("types"))
    return joined.select("path", plain_name(F.col("name")).alias("alias")).distinct().join(kinds, "path")


def path_scores(fields: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, path, score) of fields (name, type) that are called like a path's fields.

    1 for the same name, 0.9 for one that is the same but for digits at its end; 0.3 times that if the path's known types
    are others, 0.2 times if nearly all values are ``NULLISH``.
    """
    empty = counts.groupBy("name").agg((F.sum(F.when(F.lower(F.trim("value")).isin(*NULLISH), F.col("n")).otherwise(0)) >= F.sum("n") * NEARLY_ALL).alias("empty"))
    said = fields.select("name", "type", plain_name(F.col("name")).alias("plain")).join(empty, "name", "left")
    base = F.regexp_replace("plain", r"\d+$", "")
    asked = said.select("name", "type", "empty", F.explode(F.when((base != "") & (base != F.col("plain")), F.array(F.struct(F.col("plain").alias("alias"), F.lit(1.0).alias("score")), F.struct(base.alias("alias"), F.lit(0.9).alias("score")))).otherwise(F.array(F.struct(F.col("plain").alias("alias"), F.lit(1.0).alias("score"))))).alias("x"))
    met = asked.select("name", "type", "empty", "x.*").join(known, "alias")
    akin = F.lit(False)
    for mine, theirs in KINDRED:
        akin = akin | ((F.col("type") == mine) & F.array_contains("types", theirs))
    fits = F.array_contains("types", F.col("type")) | akin | (F.size("types") == 0)
    score = F.col("score") * F.when(fits, 1.0).otherwise(0.3) * F.when(F.col("empty"), 0.2).otherwise(1.0)
    return met.groupBy("name", "path").agg(F.max(score).alias("score"))


def suggest(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(name, path, score): of the best scores first, each name with one path and each path with one name.

    Best first, then by path, then by name, a pair is taken if neither side is. That is what taking, again and again, every
    pair that is the best one left for both of its sides comes to, so it is done in rounds of joins: all such pairs of a
    round at once. Every round takes the best pair left, at the least, and drops those that meet it.
    """
    left = cut(scores.filter(F.col("score") >= least).select("name", "path", "score"))
    taken = None
    rank = F.struct(-F.col("score"), "path", "name")
    while not left.isEmpty():
        by_name, by_path = (left.groupBy(side).agg(F.min(rank).alias(f"__best_{side}")) for side in ("name", "path"))
        ranked = left.join(by_name, "name").join(by_path, "path").withColumn("__own", rank)
        best = cut(ranked.filter((F.col("__own") == F.col("__best_name")) & (F.col("__own") == F.col("__best_path"))).select("name", "path", "score"))
        taken = best if taken is None else taken.unionByName(best)
        left = cut(left.join(best.select("name"), "name", "left_anti").join(best.select("path"), "path", "left_anti"))
    return left if taken is None else taken
