"""What a reader of the lake asks for: rows as an interface shows them, pages, look-ups, findings and summaries of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import bucket, millis
from ..schema import GOLD, ROW_COLUMNS, STATUSES, SUGGESTED
from . import filters, stats

#: Length of a message's preview, and references of a finding that are looked up.
PREVIEW, EVIDENCE = 140, 20


def api_rows(gold: DataFrame) -> DataFrame:
    """The 23 columns of a row in a list of events; times are epoch milliseconds and a missing coverage is 0."""
    shown = {"time": millis(F.col("time")), "recv_time": millis(F.col("recv_time")), "coverage": F.coalesce(F.col("coverage").cast("double"), F.lit(0.0))}
    return gold.select(*[shown.get(c, F.col(c)).alias(c) for c in ROW_COLUMNS])


def tail_rows(gold: DataFrame) -> DataFrame:
    """Rows without their heavy columns, and the first ``PREVIEW`` characters of the event's message."""
    heavy = ("unmapped", "event", "raw_sha256")
    kept = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c == "coverage" else F.col(c) for c in GOLD.names if c not in heavy]
    return gold.select(*kept, F.left(F.get_json_object("event", "$.message"), F.lit(PREVIEW)).alias("message"))


def encode_cursor(time_ms: Column, event_id: Column) -> Column:
    """A page's end as text that an address can hold: the JSON array of time and id in base64url without padding."""
    quoted = F.to_json(F.array(event_id))
    said = F.concat(F.lit("["), time_ms.cast("string"), F.lit(","), F.substring(quoted, 2, F.length(quoted)))
    return F.rtrim(F.translate(F.base64(said.cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct<time_ms, event_id> of a cursor; null for anything else."""
    plain = F.translate(cursor, "-_", "+/")
    lack = F.pmod(-F.length(plain), F.lit(4))
    said = F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), lack)), F.lit("base64")).cast("string")
    parts = F.from_json(said, "array<string>")
    time_ms = F.try_element_at(parts, F.lit(1)).try_cast("long")
    return F.when(F.is_valid_utf8(said) & (F.size(parts) == 2) & time_ms.isNotNull(), F.struct(time_ms.alias("time_ms"), parts[1].alias("event_id")))


def page(gold: DataFrame, size: int = 100, after: tuple | None = None) -> DataFrame:
    """A page as :func:`.filters.page` gives it, without rows whose event_id is that of the row before.

    Only the page's own rows are compared, ``size`` + 1 of them at most.
    """
    rows = filters.page(gold, size, after)
    before = F.lag("event_id").over(Window.orderBy(F.col("time").desc_nulls_last(), F.col("event_id").desc_nulls_last()))
    return rows.withColumn("__before", before).filter(~F.col("event_id").eqNullSafe(F.col("__before")) | F.col("event_id").isNull()).drop("__before")


def rows_by_refs(gold: DataFrame, wanted: DataFrame, key: str, refs: str, most: int = EVIDENCE) -> DataFrame:
    """For each row of ``wanted`` (``key``, array ``refs``), the lake rows that its first ``most`` references name, each event once.

    Repeated events keep the newest row. The references are exploded and joined, so any number of rows may ask.
    """
    asked = wanted.select(key, F.explode(F.slice(refs, 1, most)).alias("raw_ref")).distinct()
    found = asked.join(gold, "raw_ref")
    other = [c for c in gold.columns if c not in ("event_id", key)]
    best = found.groupBy(key, "event_id").agg(F.max_by(F.struct(*other), F.struct("time", "raw_ref")).alias("__row"))
    return best.select(key, "event_id", *[F.col(f"__row.{c}").alias(c) for c in other])


def recent_findings(gold: DataFrame, source: str, most: int = 50) -> DataFrame:
    """The newest findings of one source, each event once; ``most`` is held between 1 and 200."""
    mine = gold.filter((F.col("class_uid") == 2004) & (F.col("source_id") == source))
    newest = mine.orderBy(F.col("time").desc_nulls_last(), F.col("event_id").desc(), F.col("raw_ref").desc()).limit(max(1, min(200, most)))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("time").desc_nulls_last(), F.col("raw_ref").desc()))
    return newest.withColumn("__n", first).filter("__n = 1").drop("__n")


def field_catalog(spark: SparkSession) -> DataFrame:
    """(name, type, enum, suggest) of the columns that a search may name, by name."""
    rows = [(f.name, f.dataType.simpleString(), list(STATUSES) if f.name == "status" else None, f.name in SUGGESTED) for f in GOLD.fields if f.name in ROW_COLUMNS]
    return spark.createDataFrame(sorted(rows), "name string, type string, enum array<string>, suggest boolean").orderBy("name")


def suggested_values(gold: DataFrame, field: str, prefix: str = "", most: int = 20) -> DataFrame:
    """Values to complete a search with; only fields of few and harmless values have them."""
    if field not in SUGGESTED:
        raise ValueError(f"values are suggested for: {', '.join(sorted(SUGGESTED))}")
    return stats.facet(gold, field, prefix, max(1, min(100, most)))


def closest_fields(spark: SparkSession, name: str, most: int = 2) -> DataFrame:
    """Columns whose name is at most ``most`` edits from a misspelt one, closest first."""
    known = field_catalog(spark).select("name", F.levenshtein(F.col("name"), F.lit(name)).alias("edits"))
    return known.filter(F.col("edits") <= most).orderBy("edits", "name")


def source_summary(gold: DataFrame, registry: DataFrame, now_ms: int, step: int = 5_000, points: int = 2, most: int = 10) -> DataFrame:
    """One row for each source that was seen or is in ``registry`` (source_id).

    Rows, rows by status, parse rate (1 without rows), mean coverage, when it was last seen, the rate of the last
    ``points`` steps before ``now_ms``, and its ``most`` commonest unmapped keys with their counts.
    """
    known = gold.withColumn("source_id", F.coalesce("source_id", F.lit("unknown")))
    totals = stats.source_totals(known, "source_id", "status", "coverage", "recv_time")
    start = now_ms // step * step - (points - 1) * step
    recent = known.filter(bucket(millis(F.col("recv_time")), step).between(start, start + (points - 1) * step))
    rate = recent.groupBy("source_id").agg((F.count("*") / F.lit(points * step / 1000)).alias("eps"))
    pairs = known.filter("unmapped IS NOT NULL AND unmapped <> '{}'").select("source_id", F.explode(F.json_object_keys("unmapped")).alias("field"))
    keys = pairs.groupBy("source_id", "field").agg(F.count("*").alias("count"))
    order = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("count").desc(), "field"))
    top = keys.withColumn("n", order).filter(F.col("n") <= most).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "field", "count"))), lambda x: F.struct(x["field"].alias("field"), x["count"].alias("count"))).alias("top_unmapped"))
    whole = totals.join(registry.select("source_id").distinct(), "source_id", "full").join(rate, "source_id", "left").join(top, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        "source_id", zero("events").alias("events"), zero("parsed").alias("parsed"), zero("partial").alias("partial"), zero("unparsed").alias("unparsed"), F.coalesce(F.round(F.try_divide("parsed", "events"), 4), F.lit(1.0)).alias("parse_rate"),
        F.coalesce(F.round("mean_coverage", 4), F.lit(0.0)).alias("mean_coverage"), "last_seen_ms", F.coalesce(F.round("eps", 2), F.lit(0.0)).alias("eps"), "top_unmapped",
    )


def coverage_report(events: DataFrame, source: str, keys: str, unmapped: str, coverage: str, status: str) -> DataFrame:
    """How well each source's lines are mapped: lines, those matched, fields seen and mapped, and mean coverage.

    ``keys`` and ``unmapped`` are arrays of field names. A field is mapped if any line consumes it.
    """
    matched = F.col(status) != "unparsed"
    used = F.array_except(keys, unmapped)
    lines = events.groupBy(source).agg(F.count("*").alias("lines_total"), F.count_if(matched).alias("lines_matched"), F.coalesce(F.round(F.avg(F.when(matched, F.col(coverage))), 4), F.lit(0.0)).alias("mean_event_coverage"))
    # Names of fields are few, so they are counted as rows rather than gathered as sets.
    names = events.filter(matched).select(source, F.explode(keys).alias("field"), used.alias("used")).select(source, "field", F.array_contains("used", F.col("field")).alias("mapped"))
    seen = names.groupBy(source, "field").agg(F.max("mapped").alias("mapped")).groupBy(source).agg(F.count("*").alias("fields_seen"), F.count_if("mapped").alias("fields_mapped"))
    return lines.join(seen, source, "left").select(source, "lines_total", "lines_matched", F.round(F.col("lines_matched") / F.col("lines_total"), 4).alias("lines_matched_pct"), F.coalesce("fields_seen", F.lit(0)).alias("fields_seen"), F.coalesce("fields_mapped", F.lit(0)).alias("fields_mapped"), "mean_event_coverage")
