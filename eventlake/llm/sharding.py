"""Operator 9, sharding: contiguous shards of near equal bytes, cut from a global prefix sum.

Everything here is DataFrame operations. The rows (ids and sizes only, never the texts) are range-partitioned by their
order, per-partition totals give each partition's offset, a running sum inside each partition gives each row's place in the
whole, and equal cuts of the total give the shard. No task holds more than one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_back, id_key, packed, table

#: Bytes that a document costs in a shard besides its text.
ROW_BYTES = 16


def prefix_sums(rows: DataFrame, order: list[str], sums: list[str], partition: str = "__part") -> DataFrame:
    """``rows`` with ``<name>_before`` for each column of ``sums``: its total over all rows that sort before by ``order``.

    Also adds ``row_before`` (rows before) and, on every row, ``<name>_total`` and ``row_total``. The ranges are fixed by
    a checkpoint of these narrow rows, since a second sampling could cut elsewhere. ``order`` should hold no long runs of
    full ties, as these can't be split between tasks.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *[F.col(c).asc() for c in order]).withColumn(partition, F.spark_partition_id()))
    totals = ranged.groupBy(partition).agg(F.count("*").alias("row"), *[F.sum(c).alias(c) for c in sums])
    every, before = Window.orderBy(partition), Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    names = ["row", *sums]
    # One row for each partition: as many as shuffle partitions, whatever the input. Hence the broadcast is bounded too.
    offsets = totals.select(
        partition,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in names],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in names],
        F.row_number().over(every).alias("__n"),
    ).drop("__n")
    inside = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), partition)
    return joined.select(
        *[c for c in ranged.columns if c != partition],
        (F.col("__row") + F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1).alias("row_before"),
        *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in names],
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", keep_order: bool = False) -> DataFrame:
    """Shards 0 to ``shards - 1`` of near equal bytes, contiguous in the order of (hash of the text, doc_id).

    Equal texts lie side by side in that order, and it is as good as random otherwise. A row goes to the shard in which
    the middle of its bytes falls, so each shard misses its equal share by at most half a row at either end. Returns
    doc_id, size (UTF-8 bytes plus ``ROW_BYTES``), text_crc32, shard and slot (0, 1, ... within the shard).

    Null text: no bytes, crc32 0. Null doc_id: sorts first. Repeated rows are rows of their own. An empty table gives
    no rows. Other columns, whatever their names, are not read. With fewer rows than shards some shards are empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        id_key(doc_id).alias("__d"),
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("__h"),
    )
    order = ["__h", "__d"]
    placed = prefix_sums(rows, order, ["size"])
    # Twice the middle of the row's bytes against twice the total, in decimals: no overflow and no rounding.
    middle = (F.col("size_before") * 2 + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.floor(middle * shards / (F.col("size_total") * 2).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", shard)
    if keep_order:
        return placed
    # A row's slot is its distance from the shard's first row; the table of first rows has one row for each shard.
    first = placed.groupBy("shard").agg(F.min("row_before").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        id_back("__d").alias("doc_id"), "size", "text_crc32", "shard", (F.col("row_before") - F.col("__first")).alias("slot")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, and ``shard``.

    The shards' first places in the order, one for each shard, are all that comes to the driver; a row's shard follows from
    its own place, so no text is shuffled. Equal rows always share a shard here, whichever side of a cut they lie on.
    """
    placed = shard_by_bytes(docs, shards, text, doc_id, keep_order=True)
    firsts = placed.groupBy("shard").agg(F.min(F.struct("__h", "__d")).alias("first")).select("shard", "first.*").collect()
    shard = F.lit(0)
    for row in sorted(firsts):
        reached = (F.col("__h") > row["__h"]) | ((F.col("__h") == row["__h"]) & (F.col("__d") >= row["__d"]))
        shard = F.when(reached, F.lit(row["shard"])).otherwise(shard)
    rows = packed(docs, __d=id_key(doc_id), __h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("__shard", shard).select(*[F.col(f"__row.`{c}`") for c in docs.columns if c != "shard"], F.col("__shard").alias("shard"))
