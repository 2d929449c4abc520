"""Raw storage that shows tampering: hashes of frames, a chain of block hashes, and conservation of counts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import running

#: The link before the first block of a shard.
GENESIS = "0" * 64


def frames(raw: DataFrame, shard: str, order: list[Column], data: str, block_rows: int = 1000) -> DataFrame:
    """``raw`` with shard, block, idx and sha256: rows of a shard in order, ``block_rows`` to a block.

    Numbers are running sums over ranges of (shard, order), so a shard of any size is no task of its own.
    """
    numbered = running(raw, [shard], order).drop("__all")
    return numbered.select("*", F.floor(F.col("__before") / block_rows).cast("long").alias("block"), (F.col("__before") % block_rows).cast("int").alias("idx"), F.sha2(data, 256).alias("sha256")).drop("__before")


def block_hashes(stored: DataFrame, shard: str) -> DataFrame:
    """shard, block, rows and the hash of each block's frames in order; a block is at most one block's rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "sha256"))), lambda x: x["sha256"])
    return stored.groupBy(F.col(shard).alias("shard"), "block").agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("", ordered), 256).alias("block_hash"))


def chain(blocks: DataFrame) -> DataFrame:
    """``blocks`` with chain_hash, the hash of the previous link and this block's hash.

    Links follow one another, so each shard is folded in one task, over one short row for each block: shards run in
    parallel and a batch of rows at a time passes through. Checking (:func:`verify`) needs no such order.
    """

    def fold(batches):
        link, shard, seen = GENESIS, None, False
        for batch in batches:
            out = []
            for s, block_hash in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not seen or s != shard:
                    link, shard, seen = GENESIS, s, True
                link = hashlib.sha256((link + block_hash).encode()).hexdigest()
                out.append(link)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "chain_hash"])

    kind = blocks.schema["shard"].dataType.simpleString()
    rows = blocks.select("shard", "block", "rows", "block_hash").repartition("shard").sortWithinPartitions("shard", "block")
    return rows.mapInArrow(fold, f"shard {kind}, block long, rows long, block_hash string, chain_hash string")


def heads(chained: DataFrame) -> DataFrame:
    """(shard, blocks, head): how many blocks each shard has and the hash of its last link, to be kept apart from the chain."""
    return chained.groupBy("shard").agg((F.max("block") + 1).alias("blocks"), F.max_by("chain_hash", "block").alias("head"))


def verify(stored: DataFrame, chained: DataFrame, shard: str, data: str, kept: DataFrame | None = None) -> DataFrame:
    """One row a block: bad frames, and whether its hash, its link to the block before and its number are right.

    Blocks that only the chain or only the stored rows know are rows too, with ``hash_ok`` false. With ``kept``
    (:func:`heads`), so are blocks that are missing from the end of a shard in both.
    """
    bad = stored.groupBy(F.col(shard).alias("shard"), "block").agg(F.count_if(F.sha2(data, 256) != F.col("sha256")).alias("bad_frames"))
    now = block_hashes(stored, shard).select("shard", "block", F.col("rows").alias("rows_now"), F.col("block_hash").alias("hash_now"))
    w = Window.partitionBy("shard").orderBy("block")
    linked = chained.withColumn("__before", F.lag("chain_hash", 1, GENESIS).over(w)).withColumn("__last", F.lag("block", 1, -1).over(w))
    linked = linked.select("shard", "block", "rows", "block_hash", (F.sha2(F.concat("__before", "block_hash"), 256) == F.col("chain_hash")).alias("link_ok"), (F.col("block") == F.col("__last") + 1).alias("number_ok"))
    joined = linked.join(now, ["shard", "block"], "full").join(bad, ["shard", "block"], "left")
    if kept is not None:
        # The last block that there should be: if it is there, so are those before it, or their numbers have a gap.
        joined = joined.join(kept.filter("blocks > 0").select("shard", (F.col("blocks") - 1).alias("block")), ["shard", "block"], "full")
    no = F.lit(False)
    return joined.select("shard", "block", F.coalesce("bad_frames", F.lit(0)).alias("bad_frames"), F.coalesce((F.col("hash_now") == F.col("block_hash")) & (F.col("rows_now") == F.col("rows")), no).alias("hash_ok"), F.coalesce("link_ok", no).alias("link_ok"), F.coalesce("number_ok", no).alias("number_ok"))


def verify_summary(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: whether all of :func:`verify` holds, how many blocks and frames were checked, and the first block that fails."""
    bad = ~(F.col("hash_ok") & F.col("link_ok") & F.col("number_ok")) | (F.col("bad_frames") > 0)
    why = F.when(F.col("bad_frames") > 0, "frame").when(~F.col("hash_ok"), "hash").when(~F.col("link_ok"), "link").otherwise("number")
    said = blocks.agg((F.count_if(bad) == 0).alias("ok"), F.count("*").alias("blocks_checked"), F.min(F.when(bad, F.struct("shard", "block", why.alias("why")))).alias("first_failure"))
    return said.crossJoin(F.broadcast(rows.agg(F.count("*").alias("frames_checked")))).select("ok", "blocks_checked", "frames_checked", F.col("first_failure.shard").alias("bad_shard"), F.col("first_failure.block").alias("bad_block"), F.col("first_failure.why").alias("why"))


def segments(stored: DataFrame, segment: str, data: str) -> DataFrame:
    """Each segment's frames, blocks and bytes, told from the rows without hashing any."""
    return stored.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("frames"), (F.max("block") + 1).alias("blocks"), F.sum(F.octet_length(data)).alias("bytes"))


def gaps(df: DataFrame, shard: str, seq: str) -> DataFrame:
    """Places where a sequence number isn't the one before plus one."""
    before = F.lag(seq).over(Window.partitionBy(shard).orderBy(seq))
    return df.withColumn("__before", before).filter(F.col(seq) != F.col("__before") + 1).select(shard, F.col("__before").alias("after"), F.col(seq).alias("found"), (F.col(seq) - F.col("__before") - 1).alias("missing"))


def conservation(raw: DataFrame, stored: DataFrame, sha: str) -> DataFrame:
    """Hashes whose number differs between raw input and stored rows: empty if nothing was lost or invented. Rows without hash count as one."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = raw.select(sha, one.alias("n_in"), none.alias("n_out")).unionByName(stored.select(sha, none.alias("n_in"), one.alias("n_out")))
    return both.groupBy(sha).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).filter("n_in <> n_out")
