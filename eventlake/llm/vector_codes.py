"""Operator 12, vector code compression: product quantisation of whole numbers, by a reduction tree over columnar blocks.

Rows become blocks, one numpy matrix of (component, row) each. Every round is one ``treeAggregate`` of the blocks: a task adds
up the distances of its rows dimension by dimension, counts its rows and sums in int64 tensors with ``np.add.at``, and the
tensors of all tasks, some tens of KB each whatever the table's size, merge through a tree. Whole numbers make the result
independent of the order of rows and tasks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Cells of the distance matrix that are held at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the (entry, position) matrix of part p, in int64. Parts differ by one position at most."""

    entries: tuple[np.ndarray, ...]
    dims: int

    @property
    def parts(self) -> int:
        return len(self.entries)

    @property
    def size(self) -> int:
        return len(self.entries[0])

    def bounds(self) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *[e.shape[1] for e in self.entries]])
        return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def split_dims(dims: int, parts: int) -> list[slice]:
    """Consecutive parts of ``dims`` positions; where ``parts`` doesn't divide them, the first ones are longer by one."""
    sizes = [dims // parts + (p < dims % parts) for p in range(parts)]
    ends = np.cumsum([0, *sizes]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def most_whole(dims: int) -> int:
    """Whole components are held within plus and minus this, so that an error, a sum of ``dims`` squares, fits in 63 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def whole(values: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """(component, row) matrix of floor(scale * x) from the components of all rows, one row after another."""
    most = most_whole(dims)
    scaled = np.floor(values.astype(np.float64) * scale)
    return np.ascontiguousarray(np.clip(scaled, -most, most).astype(np.int64).reshape(-1, dims).T)


def usable(column: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(column, fine), F.lit(False))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def assign(block: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and squared distances (row, part) of the rows of a block; the lower index wins a tie."""
    n = block.shape[1]
    codes, errors = np.zeros((n, books.parts), np.int64), np.zeros((n, books.parts), np.int64)
    step = max(1, CELLS // max(1, books.size))
    for begin in range(0, n, step):
        rows = slice(begin, min(begin + step, n))
        for p, (low, high) in enumerate(books.bounds()):
            away = np.zeros((rows.stop - begin, books.size), np.int64)
            for d in range(low, high):
                gap = block[d, rows, None] - books.entries[p][None, :, d - low]
                away += gap * gap
            codes[rows, p] = away.argmin(1)
            errors[rows, p] = np.take_along_axis(away, codes[rows, p, None], 1)[:, 0]
    return codes, errors


def _blocks(dims: int, scale: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array([whole(_flat(batch.column(0)), dims, scale).tobytes()], pa.binary())], ["block"])

    return run


def _refined(blocks, books: Codebooks) -> Codebooks:
    """One round over an RDD of blocks: each entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    shared = blocks.context.broadcast(books)

    def add(found, data: bytes):
        books = shared.value
        block = np.frombuffer(data, np.int64).reshape(books.dims, -1)
        if found is None:
            found = np.zeros((books.size, books.dims), np.int64), np.zeros((books.parts, books.size), np.int64)
        sums, counts = found
        codes, _ = assign(block, books)
        for p, (low, high) in enumerate(books.bounds()):
            np.add.at(counts[p], codes[:, p], 1)
            for d in range(low, high):
                np.add.at(sums[:, d], codes[:, p], block[d])
        return sums, counts

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    found = blocks.treeAggregate(None, add, merge, depth=2)
    shared.unpersist()
    if found is None:
        return books
    sums, counts = found
    made = [np.where(counts[p][:, None] > 0, sums[:, low:high] // np.maximum(counts[p], 1)[:, None], books.entries[p]) for p, (low, high) in enumerate(books.bounds())]
    return Codebooks(tuple(made), books.dims)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id") -> Codebooks | None:
    """Codebooks of the usable rows of ``vectors``, or None if there are none.

    Each part's codebook starts as that part of the ``entries`` first rows by vec_id (nulls last), then by vector; ``rounds``
    rounds follow. Vectors must have one length, that of the first row; see :func:`of_length` for others.
    """
    kept = vectors.filter(usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    dims = len(first[0].v)
    kept = kept.filter(F.size("v") == dims)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = whole(np.array([x for row in seeds for x in row.v], float), dims, scale).T if dims else np.zeros((len(seeds), 0), np.int64)
    books = Codebooks(tuple(np.ascontiguousarray(start[:, s]) for s in split_dims(dims, parts)), dims)
    if dims and rounds:
        blocks = kept.select("v").mapInArrow(_blocks(dims, scale), "block binary").rdd.map(lambda row: bytes(row[0]))
        for _ in range(rounds):
            books = _refined(blocks, books)
    return books


def of_length(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``dims`` components."""
    return vectors.filter(usable(F.col(vector)) & (F.size(vector) == dims))


def _encoded(books: Codebooks, scale: int, keep: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            block = whole(_flat(batch.column(keep)), books.dims, scale) if books.dims else np.zeros((0, n), np.int64)
            codes, errors = assign(block, books) if books.dims else (np.zeros((n, books.parts), np.int64),) * 2
            digits = codes.astype(">u2" if books.size > 256 else np.uint8).tobytes().hex()
            width = len(digits) // max(1, n)
            texts = [digits[i * width : (i + 1) * width] for i in range(n)]
            yield pa.record_batch([*batch.columns[:keep], pa.array(texts, pa.string()), pa.array(errors.sum(1), pa.int64())], [*batch.schema.names[:keep], "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``keep`` columns, code (two hex digits a part; four with more than 256 entries) and error of the rows that fit ``books``."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    rows = of_length(vectors, books.dims, vector).select(*[F.col(f"`{c}`") for c in keep], F.col(vector).cast("array<double>").alias("__v"))
    return rows.mapInArrow(_encoded(books, scale, len(keep)), f"{kinds}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = 256) -> DataFrame:
    """``codes`` with ``decoded``, the vector (entries over ``scale``) that each code stands for."""
    width = 4 if books.size > 256 else 2

    @F.pandas_udf("array<double>")
    def back(strings: pd.Series) -> pd.Series:
        return strings.map(lambda s: np.concatenate([books.entries[p][int(s[p * width : (p + 1) * width], 16)] for p in range(books.parts)]) / scale, na_action="ignore")

    return codes.withColumn("decoded", back(code))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the usable rows of ``vectors``.

    Rows whose vector is null or holds nulls or components that aren't finite are left out, as are those whose length is not
    that of the first usable row by vec_id. Fewer than ``entries`` rows make smaller codebooks. Null vec_ids sort last;
    repeated rows are rows of their own, and of one vec_id the smaller vector comes first. Lengths that ``parts`` doesn't
    divide give longer first parts. Components beyond :func:`most_whole` (2**27 for 64 of them) are held at it. Extra
    columns are not read. An empty table gives no rows. label_error sums errors over equal labels, nulls together, and is
    null if it leaves 64 bits.

    Scale: each round scans the table once and shuffles one tensor a task; codebooks, ``entries`` x length numbers, go to all
    tasks. Label sums are partial aggregates, so a label of a third of all rows sends one row a task.
    """
    books = fit(vectors, parts, entries, rounds, scale, vector, vec_id)
    columns = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    books = books or Codebooks(tuple(np.zeros((0, 0), np.int64) for _ in range(parts)), 0)
    if not books.size:
        columns = columns.limit(0)
    coded = encode(columns, books, ["vec_id", "label"], scale, "v")
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
