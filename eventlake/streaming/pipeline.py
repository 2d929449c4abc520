"""The lake as a stream: files of raw lines in, raw and normalised rows out, each event once.

Raw rows are written before anything is derived from them. A batch writes into folders named after it (those of the lake lie
below class, day and hour, so that scans prune them), replacing what a failed attempt left there, and its ledger rows last; a
replayed batch therefore loses and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import filters, normalize
from ..operators.mapping import Source
from ..session import cut
from ..sources import lake
from . import rate

RAW = "raw_id string, recv_ms long, line string"


def raw_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Raw lines as JSON objects in files that arrive whole under ``path``."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_a_batch).json(path)


#: What a batch is normalised by: sources, or a function that gives those of a batch (see :mod:`.registry`).
Sources = list[Source] | Callable[[SparkSession, int], list[Source]]


def write_batch(sources: Sources, root: str, drop_unparsed: bool = False, cap: rate.Cap | None = None):
    """The function for ``foreachBatch``: raw, lake and ledger of one batch, in that order.

    ``drop_unparsed`` keeps rows that no source took out of the lake, counted as ``dropped:unparsed_dropped``: what was
    received is what was stored and what was dropped. With ``cap``, a view of the lake's rows in ``root/tail`` holds no more
    of each source than that; those left out of it are counted as ``skipped:tail_rate``, and lake and raw rows stay whole.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"batch_id={batch_id}"
        now = sources if isinstance(sources, list) else sources(spark, batch_id)
        envelope = normalize.envelope(batch.filter("raw_id IS NOT NULL"), "line", "raw_id", "recv_ms")
        envelope.write.mode("overwrite").parquet(f"{root}/raw/{here}")
        raw = spark.read.parquet(f"{root}/raw/{here}")  # what follows comes from what is stored
        gold, dropped = normalize.normalize(raw, now), None
        if drop_unparsed:
            gold, dropped = lake.without_unparsed(cut(gold))
        gold = lake.partitioned(gold).withColumn("batch_id", F.lit(batch_id))
        # A replayed batch replaces its own folders below each hour; those it wrote before in other hours are removed first.
        lake.drop_batch(spark, f"{root}/lake", batch_id)
        gold.write.partitionBy("class_uid", "dt", "hour", "batch_id").mode("append").option("compression", "zstd").parquet(f"{root}/lake")
        # The schema is given, as a lake to which nothing was written yet has no file that tells it.
        stored = spark.read.schema(gold.schema).parquet(f"{root}/lake").filter(F.col("batch_id") == batch_id)
        counts = raw.select(F.lit("received").alias("field")).unionByName(stored.select(F.col("status").alias("field"))).groupBy("field").agg(F.count("*").alias("n"))
        if dropped is not None:
            counts = counts.unionByName(dropped.groupBy("field").agg(F.sum("n").alias("n")))
        if cap is not None:
            counts = counts.unionByName(_write_tail(stored, root, batch_id, cap))
        counts.write.mode("overwrite").parquet(f"{root}/ledger/{here}")

    return run


def _write_tail(stored: DataFrame, root: str, batch_id: int, cap: rate.Cap) -> DataFrame:
    """The capped view of one batch, its buckets for the next one, and what the ledger says of both."""
    spark = stored.sparkSession
    counted = stored.groupBy("source_id").agg(F.unix_millis(F.max("recv_time")).alias("at"), F.count("*").alias("n"))
    before = f"{root}/rate/batch_id={batch_id - 1}"
    state = spark.read.parquet(before).select("source_id", "held", "at") if lake.matching(spark, f"{before}/_SUCCESS") else None
    rate.allowed(counted.withColumn("at", F.coalesce("at", F.lit(0).cast("long"))), "source_id", cap, state).write.mode("overwrite").parquet(f"{root}/rate/batch_id={batch_id}")
    buckets = spark.read.parquet(f"{root}/rate/batch_id={batch_id}")
    shown = rate.let_through(stored, ["source_id"], [F.col("recv_time"), F.col("event_id")], buckets.filter("n > 0"))
    shown.drop("batch_id").write.mode("overwrite").parquet(f"{root}/tail/batch_id={batch_id}")
    sums = buckets.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("shown"), F.coalesce(F.sum(F.col("n") - F.col("taken")), F.lit(0)).alias("skipped"))
    return sums.select(F.explode(F.array(F.struct(F.lit("tail").alias("field"), F.col("shown").alias("n")), F.struct(F.lit("skipped:tail_rate").alias("field"), F.col("skipped").alias("n")))).alias("x")).select("x.*")


def start(stream: DataFrame, sources: Sources, root: str, once: bool = False, delay: str | None = None, drop_unparsed: bool = False, cap: rate.Cap | None = None) -> StreamingQuery:
    """Runs the pipeline. With ``delay``, rows that were delivered before, as far back as that, are left out first.

    Sources given as :func:`.registry.for_batches` may change between batches.
    """
    if delay is not None:
        stream = once_each(stream.withColumn("__at", F.timestamp_millis("recv_ms")), "raw_id", "__at", delay).drop("__at")
    writer = stream.writeStream.foreachBatch(write_batch(sources, root, drop_unparsed, cap)).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def once_each(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream without redelivered rows, as far back as ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def live_features(stream: DataFrame, time: str, source: str, deny: Column, sent: Column, step: str = "60 seconds", delay: str = "2 minutes") -> DataFrame:
    """Counts by source and window of a stream; distinct counts are sketches, whose state is bounded."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, step).alias("w"), source)
    return rows.agg(F.count("*").alias("events"), F.count_if(deny).alias("denied"), F.sum(sent).alias("bytes_out"), F.approx_count_distinct("dst_ip").alias("uniq_dst_ip"))


def tail(stream: DataFrame, terms: list[filters.Term], table: str, checkpoint: str, most: int = 20_000) -> StreamingQuery:
    """Keeps the newest ``most`` rows of a stream that meet ``terms`` in the global temporary view ``table``."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = filters.search(batch, terms)
        held = f"global_temp.{table}"
        if spark.catalog.tableExists(held):
            rows = spark.table(held).unionByName(rows)
        kept = rows.orderBy(F.col("time").desc_nulls_last(), F.col("event_id").desc()).limit(most)
        spark.createDataFrame(kept.toArrow(), kept.schema).createOrReplaceGlobalTempView(table)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
