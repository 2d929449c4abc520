"""Operator 4, line dedup: lines that many documents share are kept once.

Lines are exploded with their positions, normalised and hashed; distinct documents are counted for each hash; the positions
of lines to drop come back to their document in a join, where the remaining lines are put together again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, digest, id_back, id_key, row_hash, table


def line_key(line: Column) -> Column:
    """A line's key: white space at both ends gone, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _reassemble(batches):
    for batch in batches:
        texts, drops = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            if drop:
                gone = set(drop)
                lines = text.split("\n")
                n_lines.append(len(lines))
                text = "\n".join([x for i, x in enumerate(lines) if i not in gone])
                n_dropped.append(len(gone))
            else:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
            kept.append(text)
        yield pa.record_batch([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["__d", "n_lines", "n_dropped", "kept_text"])


def drop_common_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of ``docs``.

    A key of at least ``least_chars`` code points in at least ``least_docs`` documents loses all its lines but those of
    the largest doc_id that holds it. Texts are split at ``\\n``; a null or empty text is one empty line and stays.

    Null doc_id: all such rows count as one document, smaller than any other. Rows of one doc_id are one document, but each
    text (told apart by ``__x``, its hash) loses its own lines. Extra columns are not read. An empty table gives no rows.

    Scale: each document sends a hash once however often it repeats a line, hashes are counted with partial sums, so a
    line that a third of all documents share costs one row a task. Only the lines that go are joined back to documents.
    """
    whole = docs.select(id_key(doc_id).alias("__d"), row_hash(text).alias("__x"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    lines = whole.select("__d", "__x", F.posexplode(F.split("__t", "\n", -1)).alias("__pos", "__line"))
    lines = lines.filter(F.length("__line") >= least_chars).select("__d", "__x", "__pos", line_key(F.col("__line")).alias("__key"))
    h1, h2 = digest(F.col("__key"))
    lines = lines.filter(F.length("__key") >= least_chars).select("__d", "__x", "__pos", h1.alias("__h1"), h2.alias("__h2"))
    once = lines.groupBy("__h1", "__h2", "__d").agg(F.lit(1).alias("__one"))
    common = once.groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.max("__d").alias("__keep")).filter(F.col("__n") >= least_docs)
    # Dealt anew, the counts are a shuffle of their own beside the lines: Spark can broadcast them if small, and split hot keys.
    common = common.hint("rebalance")
    gone = lines.join(common, ["__h1", "__h2"]).filter(F.col("__d") != F.col("__keep"))
    gone = gone.groupBy("__d", "__x").agg(F.collect_set("__pos").alias("__gone"))
    made = whole.join(gone, ["__d", "__x"], "left").select("__d", "__t", "__gone").mapInArrow(_reassemble, "__d long, n_lines long, n_dropped long, kept_text string")
    return made.select(id_back("__d").alias("doc_id"), "n_lines", "n_dropped", "kept_text")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
