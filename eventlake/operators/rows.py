"""Row-wise set and order operations: deduplication, differences, lookups by key, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def first_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; rows without a key all stay."""
    ranked = df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return ranked.unionByName(df.filter(F.col(key).isNull()))


def newest_by_key(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, by a partial aggregate rather than a sort: rows of a hot key meet as one a task."""
    other = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*other), F.struct(time, tie)).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in other])


def earliest_by_key(df: DataFrame, key: str, place: Column) -> DataFrame:
    """The row of each key with the smallest ``place``, by a partial aggregate like :func:`newest_by_key`; rows without a key all stay."""
    other = [c for c in df.columns if c != key]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*other), place).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in other]).select(df.columns).unionByName(df.filter(F.col(key).isNull()))


def compact(parts: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Several files' rows as one set: columns missing in some are null, and a key that was written twice stays once."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return first_by_key(whole, key, order)


def not_yet(new: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``known``."""
    return new.join(known.select(on).distinct(), on, "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those that ``b`` has, with repeats."""
    return a.exceptAll(b)


def outer_registry(seen: DataFrame, registry: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Everything seen or registered, with ``defaults`` for what one of them doesn't say."""
    return seen.join(registry, on, "full").fillna(defaults)


def running(df: DataFrame, by: list[str], order: list[Column], n: Column | None = None, near: list[Column] | None = None) -> DataFrame:
    """``df`` with ``__before``, the sum of ``n`` (1 if left out) over rows of the same ``by`` that sort before, and ``__all``, over all.

    Rows are range-partitioned by (by, order), each range's total gives the offset of the ranges after it, and a running
    sum inside the range does the rest: no task holds more than one range, however large a group or the table is. The
    ranges are fixed by a checkpoint, since a second sampling could cut elsewhere. The driver samples what ranges are cut by:
    for an order of long texts ``near`` is a short one that never contradicts it, and rows equal in that share a range.
    """
    n = F.lit(1).cast("long") if n is None else n
    marked = df.select("*", n.alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(marked.repartitionByRange(parts, *by, *(near or order)).withColumn("__part", F.spark_partition_id()))
    held = _spanning(ranged, by) if by else ranged
    totals = held.groupBy(*by, "__part").agg(F.sum("__n").alias("__sum"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"), F.sum("__sum").over(over).alias("__whole"))
    joined = ranged.alias("r").join(F.broadcast(offsets).alias("o"), _equal([*by, "__part"], "r", "o"), "left").select("r.*", "__offset", "__whole")
    group = Window.partitionBy("__part", *by)
    before = F.sum("__n").over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = joined.withColumns({"__before": F.coalesce("__offset", F.lit(0)) + F.coalesce(before, F.lit(0)), "__all": F.coalesce("__whole", F.sum("__n").over(group))})
    return out.drop("__n", "__part", "__offset", "__whole")


def _spanning(ranged: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the groups that can lie in several ranges: those at their ends, two a range, so few that they are broadcast."""
    ends = ranged.groupBy("__part").agg(F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi"))
    edges = ends.select("lo.*").unionByName(ends.select("hi.*")).distinct()
    return ranged.alias("r").join(F.broadcast(edges).alias("e"), _equal(by, "r", "e"), "left_semi")


def carried(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with columns ``values``, each the last value that isn't null at or before the row, among rows of the same ``by``.

    Like :func:`running` it works by ranges: rows of a group that begins in an earlier range take what was last there, so no
    task holds more than one range, however large a group is. Of rows with equal ``order`` any may come first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumns(values).repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*order)
    ends = _spanning(ranged, by).groupBy(*by, "__part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in values])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(*by, "__part", *[F.last(c, ignorenulls=True).over(before).alias(f"__was_{c}") for c in values])
    joined = ranged.alias("r").join(F.broadcast(known).alias("k"), _equal([*by, "__part"], "r", "k"), "left").select("r.*", *[f"__was_{c}" for c in values])
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), f"__was_{c}") for c in values}).drop("__part", *[f"__was_{c}" for c in values])


def _equal(columns: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def stride_sample(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``most`` rows at equal distances in ``order`` (row ``i * n // most``), or all if there are fewer."""
    ranked = running(df, [], order).withColumnsRenamed({"__before": "__i", "__all": "__n"})
    i = F.expr(f"(__i * {int(most)} + __n - 1) div __n")  # the only step that can fall on this row
    kept = ranked.filter((F.col("__n") <= most) | (i < most) & (F.floor(i * F.col("__n") / most) == F.col("__i")))
    return kept.drop("__i", "__n")


def zipped(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Row ``i`` of ``a`` beside row ``i`` of ``b`` (as structs ``a`` and ``b``), each by its column ``order``; the longer one's rest goes with nulls."""
    left = running(a, [], [F.col(order)]).select(F.col("__before").alias("i"), F.struct(*a.columns).alias("a"))
    right = running(b, [], [F.col(order)]).select(F.col("__before").alias("i"), F.struct(*b.columns).alias("b"))
    return left.join(right, "i", "full")


def hash_sample(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """The same share of rows on every run: those whose key's hash is divisible by ``one_in``."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a source: one source, one partition."""
    return F.crc32(key) % partitions
