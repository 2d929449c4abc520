"""The corpus pipeline: five operators, each reading what the stage before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``. ``run`` writes
each stage as Parquet into the shared folder of ``spark.checkpoint.dir`` and reads it again, so lineage ends at each stage; the
folder of a stage goes once the stage after it is written.

All stages take whole texts of any length, and empty tables, which give empty tables. Extra columns pass through unread,
whatever their names; a column ``shard`` is replaced by the last stage. Null doc_ids, null or empty texts and repeated rows are
defined for each stage below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import decontamination, mixing, near_dedup, quality, sharding
from eventlake.llm.common import ensure_checkpoint_dir, remove, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``.

    Rows are judged by their text alone, so repeats share their fate; a null text counts as empty. Rows without doc_id are
    judged like others, but none is learned from.
    """
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest doc_id of a group stays, one row of it if it is repeated. Documents without words are near nothing and
    stay. A row without doc_id is smaller than any other, so it stays with those that aren't near a smaller one.
    """
    return near_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``.

    Texts without words hold none and stay, as do all texts if the benchmark is empty; repeats share their fate. Rows without
    doc_id are told apart by their texts.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words add nothing to the mix and are left out. Sources may be null, which is one source like others.
    Repeated rows are drawn alike.
    """
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, 40 of near equal bytes.

    Equal rows share a shard. Null texts have no bytes, and rows without doc_id sort first among equal texts.
    """
    return sharding.sharded(docs, 40)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", cut_shards),
]

#: A trained network and MinHash tables can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The last stage is returned unwritten."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
