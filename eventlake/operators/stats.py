"""Aggregates over events: facets, histograms, source statistics, unmapped keys, ledgers and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import bucket, millis
from .rows import running

# Steps of a histogram, in milliseconds (1 s to 7 days).
NICE_STEPS = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 600_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000, 604_800_000)


def nice_step(span_ms: int, buckets: int) -> int:
    """The first step that needs at most ``buckets`` (10 to 200) for the span."""
    buckets = min(200, max(10, buckets))
    return next((s for s in NICE_STEPS if span_ms / s <= buckets), NICE_STEPS[-1])


def facet(df: DataFrame, column: str, prefix: str = "", most: int = 10) -> DataFrame:
    """The commonest values of ``column`` that start with ``prefix``, whatever the case; ties by value."""
    df = df.filter(F.col(column).isNotNull())
    if prefix:
        df = df.filter(F.lower(column).startswith(prefix.lower()))
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col("value").asc()).limit(most)


def histogram(df: DataFrame, time: str, by: str, values: list[str], step: int, distinct: str | None = None) -> DataFrame:
    """Rows (or distinct ``distinct``) for each step of time, a column for each of ``values``; only steps with rows."""
    base = df.select(bucket(millis(F.col(time)), step).alias("bucket_ms"), F.col(by).alias("__v"), *([F.col(distinct).alias("__id")] if distinct else []))
    one = lambda v: F.count_distinct(F.when(F.col("__v") == v, F.col("__id"))) if distinct else F.count_if(F.col("__v") == v)
    return base.groupBy("bucket_ms").agg(*[one(v).alias(v) for v in values])


def zero_filled(counts: DataFrame, key: str, step: int, columns: list[str]) -> DataFrame:
    """``counts`` with a row of zeros for each step between its first and last that has none.

    The calendar is made from the bounds inside the plan: one row, exploded to one for each step.
    """
    ends = counts.agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a IS NOT NULL")
    calendar = ends.select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(key))
    return calendar.join(counts, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def source_totals(df: DataFrame, source: str, status: str, coverage: str, received: str) -> DataFrame:
    """Per source: rows, rows of each status, mean coverage and when it was last seen."""
    return df.groupBy(F.col(source).alias("source_id")).agg(
        F.count("*").alias("events"), F.count_if(F.col(status) == "parsed").alias("parsed"), F.count_if(F.col(status) == "partial").alias("partial"), F.count_if(F.col(status) == "unparsed").alias("unparsed"), F.avg(coverage).alias("mean_coverage"), F.max(millis(F.col(received))).alias("last_seen_ms")
    )


def source_series(df: DataFrame, source: str, status: str, coverage: str, received: str, step: int) -> DataFrame:
    """Per source and step: rows, rate a second, parse rate and mean coverage (4 decimals)."""
    counts = df.groupBy(F.col(source).alias("source_id"), bucket(millis(F.col(received)), step).alias("bucket_ms")).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "parsed").alias("ok"), F.sum(coverage).alias("covered"))
    return counts.select("source_id", "bucket_ms", "n", (F.col("n") / (step / 1000)).alias("eps"), F.round(F.col("ok") / F.col("n"), 4).alias("parse_rate"), F.round(F.col("covered") / F.col("n"), 4).alias("coverage"))


def drift(df: DataFrame, source: str, status: str, coverage: str, received: str, recent_ms: int, least: int = 50) -> DataFrame:
    """Why a source's latest rows look worse than all of them: parse rate down by 0.05, or coverage by 0.08."""
    marked = df.select(F.col(source).alias("source_id"), (F.col(status) == "parsed").cast("int").alias("ok"), F.col(coverage).alias("c"), (millis(F.col(received)) >= recent_ms).alias("new"))
    by = marked.groupBy("source_id").agg(F.count_if("new").alias("recent"), F.avg("ok").alias("rate"), F.avg("c").alias("covered"), F.avg(F.when(F.col("new"), F.col("ok"))).alias("new_rate"), F.avg(F.when(F.col("new"), F.col("c"))).alias("new_covered"))
    enough = F.col("recent") >= least
    return by.select(
        "source_id", "recent", (enough & (F.col("new_rate") < F.col("rate") - 0.05)).alias("parse_rate_fell"), (enough & (F.col("new_covered") < F.col("covered") - 0.08)).alias("coverage_fell")
    )


def unmapped_keys(df: DataFrame, document: str, time: str, key: str, newest: int | None = 3000, most: int = 200) -> DataFrame:
    """How often each key occurs in the JSON objects of the newest rows, with its newest value as an example."""
    rows = df.filter(F.col(document).isNotNull() & (F.col(document) != "{}"))
    if newest is not None:
        rows = rows.orderBy(F.col(time).desc(), F.col(key).desc()).limit(newest)
    pairs = rows.select(time, key, F.explode(F.from_json(document, "map<string,string>")).alias("name", "value"))
    counted = pairs.groupBy("name").agg(F.count("*").alias("n"), F.substring(F.max_by("value", F.struct(time, key)), 1, 120).alias("example"))
    return counted.orderBy(F.col("n").desc(), "name").limit(most)


def ledger_totals(deltas: DataFrame, source: str, field: str, n: str, fields: list[str]) -> DataFrame:
    """Per source, the sum of each field's deltas, what is under way, and whether every row received is accounted for."""
    wide = deltas.groupBy(F.col(source).alias("source_id")).agg(*[F.coalesce(F.sum(F.when(F.col(field) == f, F.col(n))), F.lit(0)).alias(f) for f in fields])
    received, *ends = fields
    ended = sum((F.col(e) for e in ends), F.lit(0))
    return wide.withColumn("in_flight", F.col(received) - ended).withColumn("conserved", F.col(received) == ended)


def prefix_sums(deltas: DataFrame, key: str, n: str, prefix: str) -> DataFrame:
    """(name, n): the sums of counters that are named ``prefix:name``, such as rows dropped by reason or sent by sink."""
    parts = F.col(key)
    mine = deltas.filter(F.split_part(parts, F.lit(":"), F.lit(1)) == prefix).filter(F.instr(parts, ":") > 0)
    return mine.groupBy(F.substring(parts, F.length(F.lit(prefix)) + 2, F.length(parts)).alias("name")).agg(F.sum(n).alias("n"))


def bounded_histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    """Rows in each of the buckets that end at ``bounds`` (inclusive) and above the last, with their number and sum."""
    place = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        place = F.when(F.col(value) <= b, F.lit(i)).otherwise(place)
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*[F.count_if(place == i).alias(f"b{i}") for i in range(len(bounds) + 1)], F.sum(value).alias("sum"), F.count("*").alias("n"))


def throughput(samples: DataFrame, time: str, done: str, by: list[str]) -> DataFrame:
    """Rate between the first samples at which a tenth and nine tenths of all rows are done; null without such a span."""
    whole = samples.groupBy(*by).agg(F.max(done).alias("__all"))
    joined = samples.join(whole, by) if by else samples.crossJoin(F.broadcast(whole))
    first = lambda share: F.min(F.when(F.col(done) >= F.floor(F.col("__all") * share), F.struct(time, done)))
    ends = joined.groupBy(*by).agg(first(0.1).alias("a"), first(0.9).alias("b"))
    return ends.select(*by, F.when(F.col(f"b.{time}") > F.col(f"a.{time}"), (F.col(f"b.{done}") - F.col(f"a.{done}")) / (F.col(f"b.{time}") - F.col(f"a.{time}"))).alias("rate"))


def precision_recall(df: DataFrame, truth: Column, found: Column, by: str) -> DataFrame:
    """Precision, recall and F1 of a yes/no finding, for each value of ``by`` and for ALL."""
    base = df.select(F.col(by).cast("string").alias("g"), truth.alias("t"), found.alias("f"))
    sums = base.rollup("g").agg(F.count_if(F.col("t") & F.col("f")).alias("tp"), F.count_if(~F.col("t") & F.col("f")).alias("fp"), F.count_if(F.col("t") & ~F.col("f")).alias("fn"), F.grouping("g").alias("whole"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return sums.select(F.when(F.col("whole") == 1, "ALL").otherwise(F.col("g")).alias("part"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def value_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v, before, upto, all): each distinct value of each column, as a double, and how many rows have less, and at most that.

    Values are counted with partial sums; the ranks are running sums over ranges of values, so no task sees a whole column.
    """
    pairs = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "v")).filter("v IS NOT NULL")
    counts = pairs.groupBy("name", "v").agg(F.count("*").alias("n"))
    return running(counts, ["name"], [F.col("v")], F.col("n")).select("name", "v", F.col("__before").alias("before"), (F.col("__before") + F.col("n")).alias("upto"), F.col("__all").alias("all"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, median): the exact median of each column, the mean of the middle two of an even number.

    A sketch of each column, whose error is bounded, tells two values that the middle ones lie between; then rows are
    counted below, and by value only between. So nothing is sorted, and some ten-thousandths of the rows, at most, meet.
    """
    spark = df.sparkSession
    near = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.4997, 0.5003], 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    bounds = {c: near[i] for i, c in enumerate(columns) if near[i] is not None}
    found: dict[str, float | None] = dict.fromkeys(columns)
    if bounds:

        def placed(c: str) -> Column:
            v, (low, high) = F.col(c).cast("double"), bounds[c]
            zone = F.when(v < low, 0).when(v <= high, 1).when(v.isNotNull(), 2)
            return F.struct(F.lit(c).alias("name"), zone.alias("zone"), F.when(zone == 1, v).alias("v"))

        counts = df.select(F.explode(F.array(*[placed(c) for c in bounds])).alias("x")).select("x.*").filter("zone IS NOT NULL").groupBy("name", "zone", "v").agg(F.count("*").alias("n"))
        ranked = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("name").orderBy("zone", "v")), "all": F.sum("n").over(Window.partitionBy("name"))})
        at = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (F.col("upto") > i) & (F.col("zone") == 1), F.col("v")))
        found |= {r.name: r.median for r in ranked.groupBy("name").agg(((at(F.expr("(all - 1) div 2")) + at(F.expr("all div 2"))) / 2).alias("median")).collect()}
    if missed := [c for c in bounds if found[c] is None]:  # the sketch was further off than it may be
        ranks = value_ranks(df, missed)
        at = lambda i: F.max(F.when((F.col("before") <= i) & (F.col("upto") > i), F.col("v")))
        found |= {r.name: r.median for r in ranks.groupBy("name").agg(((at(F.expr("(all - 1) div 2")) + at(F.expr("all div 2"))) / 2).alias("median")).collect()}
    return spark.createDataFrame(list(found.items()), "name string, median double")


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """The values at index ``int(share * n)`` of the sorted column, for each share."""
    index = lambda s: F.least(F.floor(F.col("all") * s), F.col("all") - 1)
    ranks = value_ranks(df, [column])
    return ranks.agg(*[F.max(F.when((F.col("before") <= index(s)) & (F.col("upto") > index(s)), F.col("v"))).alias(f"p{round(s * 100)}") for s in shares])
