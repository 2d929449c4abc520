"""Helpers shared by the training-data operators: row keys, checkpoints and vectorised word hashing.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. :class:`Words` finds and hashes every word of an Arrow batch of texts in
numpy passes over the batch's UTF-8 bytes, so that no Python code runs per word.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII control characters that end a word or a line key.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"
#: Stands for a null doc_id inside an operator, so that joins and minima treat such rows as one smallest document.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests), one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "eventlake-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a counted table for each of its partitions.
ROWS_A_PART = 50_000


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut` of narrow rows, in as many partitions as they need, and their number ``n`` (and aggregates ``more``).

    A stage leaves as many files as it has tasks, so small tables in the partitions of the shuffle before them would cost
    more in files than in rows. The number is observed while they are written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()]).checkpoint(eager=True)
    found = seen.get
    return out.coalesce(max(1, -(-found["n"] // ROWS_A_PART))), found


def id_key(column: str | Column = "doc_id") -> Column:
    """A doc_id without nulls (see ``NULL_ID``)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def id_back(key: str) -> Column:
    """The doc_id that :func:`id_key` stands for."""
    return F.when(F.col(key) != NULL_ID, F.col(key))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` with all columns in one struct ``__row``, so that no name of theirs clashes with one of ours, and ``more``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(name) for name, c in more.items()])


def row_hash(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id (or of none) with different texts apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a 128-bit digest that stays in generated code."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


# Multipliers of the word hash and of its final mix (64-bit odd numbers; the mix is that of MurmurHash3).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """``base ** i`` and ``base ** -i`` modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            step, back = np.uint64(pow(self.base, m, 1 << 64)), np.uint64(pow(_inverse(self.base), m, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step]), np.concatenate([self.down, self.down * back])
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(int(_BASE)), _Powers(0xD6E8FEB86659FD93)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the offsets of its rows in them; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


#: Bytes of text that the numpy passes take at a time: their arrays stay small and in cache.
SLICE_BYTES = 1 << 20


class Words:
    """All words of a batch of texts. ``start``/``end``: their bytes; ``first[i]:first[i + 1]``: the words of row i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        if lower:
            self.data = _LOWER[self.data]
        # Row ends count as spaces: a flag is put between the rows, so words never run over them.
        solid = ~_IS_SPACE[self.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, made for some ``SLICE_BYTES`` of words at a time."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            begin = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, begin + SLICE_BYTES, "right")))
            data = self.data[begin : self.end[upto - 1]]
            up, down = _BYTE_POWERS.get(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
            start, end = self.start[at:upto] - begin, self.end[at:upto] - begin
            out[at:upto] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
            at = upto
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive values; fewer values give none."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    k = len(values) - n + 1
    return mix((sums[n : n + k] - sums[:k]) * down[:k])


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the values from each ``start`` up to its ``end``."""
    up, down = _WORD_POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(values: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one shingle, none make none."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(values, min(n, len(values))))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Runs of rows of ``batch`` with about ``most`` bytes in ``column``; a longer text is a run of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.diff(buffers(texts)[1]))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def ragged(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row i holds ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
