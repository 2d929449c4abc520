"""Operator 5, quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of two cells that overlap by one cell, so they cover all of it. Each chunk has the mean
response of learned filters over three bytes and, from comparison filters, the largest share of bytes that repeat the byte
``lag`` places before. Chunk responses are pooled over the document by maximum and by mean and combined into one
probability. Training is by gradient descent through both pools, on a bounded sample of labelled rows; scoring is a map over
all documents with a few thousand weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, packed, slices, table

#: Bytes of a cell (half a chunk), filters, bytes of a filter, and lags of the comparison filters.
CELL, FILTERS, TAPS, LAGS = 32, 8, 3, range(2, 22)
#: Labelled rows of either class that training takes at most.
SAMPLE = 1200
#: Bytes that are scored at a time.
SLICE = 1 << 18


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty rows: their indices, cells each, first cell each, and the first byte of every cell."""
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes)
    cells = -(-sizes[rows] // CELL)
    first = np.cumsum(cells) - cells
    starts = np.arange(int(cells.sum())) - np.repeat(first, cells)
    return rows, cells, first, starts * CELL + np.repeat(offsets[rows], cells)


def echoes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(cells, lags): how many bytes of a cell equal the byte ``lag`` before in the same row."""
    out = np.zeros((len(starts), len(LAGS)), np.float32)
    begin = np.unique(offsets[:-1][np.diff(offsets) > 0])
    for k, lag in enumerate(LAGS):
        same = np.zeros(len(data), np.uint8)
        if len(data) > lag:
            same[lag:] = data[lag:] == data[:-lag]
        for j in range(lag):
            at = begin + j
            same[at[at < len(data)]] = 0
        out[:, k] = np.add.reduceat(same, starts, dtype=np.int32)
    return out


class Network:
    """The weights, and the passes over a batch of rows given as bytes and offsets."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32)
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.weights = np.zeros(2 * (FILTERS + 1), np.float32)
        self.prior = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.weights, self.prior]

    def forward(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        rows, cells, first, starts = _layout(offsets)
        n = len(data)
        ahead = np.zeros((TAPS, n), np.uint8)  # rows end in zero bytes, as far as a filter looks ahead
        ends = offsets[1:]
        for t in range(TAPS):
            ahead[t, : n - t] = data[t:]
            for j in range(1, t + 1):
                at = ends - j
                ahead[t, at[(at >= 0) & (ends > offsets[:-1])]] = 0
        response = self.taps[0][ahead[0]]
        for t in range(1, TAPS):
            response += self.taps[t][ahead[t]]
        response += self.bias
        np.maximum(response, 0, out=response)
        sums = np.concatenate([np.add.reduceat(response, starts, axis=0), echoes(data, offsets, starts)], axis=1)
        size = np.minimum(CELL, np.repeat(offsets[rows + 1], cells) - starts).astype(np.float32)
        # A chunk is a cell and the next of the same row; the last cell is a chunk of its own only in rows of one cell.
        last = np.zeros(len(starts), bool)
        last[first + cells - 1] = True
        alone = np.repeat(cells == 1, cells)
        pair = np.where(last, 0, 1)[:, None]
        following = np.concatenate([sums[1:], sums[:1]])
        total = size + pair[:, 0] * np.concatenate([size[1:], size[:1]])
        whole = (sums + pair * following) / total[:, None]
        used = np.flatnonzero(~last | alone)
        chunks = np.concatenate([whole[used, :FILTERS], whole[used, FILTERS:].max(axis=1, keepdims=True)], axis=1)
        per = np.maximum(cells - 1, 1)
        begin = np.cumsum(per) - per
        top, mean = np.maximum.reduceat(chunks, begin), np.add.reduceat(chunks, begin) / per[:, None]
        pooled = np.zeros((len(offsets) - 1, 2 * (FILTERS + 1)), np.float32)
        pooled[rows] = np.concatenate([top, mean], axis=1)
        score = pooled @ self.weights + self.prior
        return {"score": 1 / (1 + np.exp(-np.clip(score, -30, 30))), "pooled": pooled, "chunks": chunks, "top": top, "per": per, "rows": rows, "used": used, "total": total, "pair": pair, "response": response, "ahead": ahead, "starts": starts}

    def gradients(self, passed: dict, error: np.ndarray) -> list[np.ndarray]:
        """Of the loss whose derivative by each row's logit is ``error``."""
        pooled = error[:, None] * self.weights
        d_top, d_mean = pooled[passed["rows"], :FILTERS], pooled[passed["rows"], FILTERS + 1 : 2 * FILTERS + 1]
        per, chunks = passed["per"], passed["chunks"][:, :FILTERS]
        won = chunks == np.repeat(passed["top"][:, :FILTERS], per, axis=0)
        d_chunk = won * np.repeat(d_top, per, axis=0) + np.repeat(d_mean / per[:, None], per, axis=0)
        d_cell = np.zeros((len(passed["starts"]), FILTERS), np.float32)
        share = d_chunk / passed["total"][passed["used"]][:, None]
        d_cell[passed["used"]] += share
        both = passed["pair"][passed["used"], 0] == 1
        d_cell[passed["used"][both] + 1] += share[both]
        sizes = np.diff(np.concatenate([passed["starts"], [passed["response"].shape[0]]]))
        d = np.repeat(d_cell, sizes, axis=0) * (passed["response"] > 0)
        taps = np.empty_like(self.taps)
        for f in range(FILTERS):
            column = np.ascontiguousarray(d[:, f])
            for t in range(TAPS):
                taps[t, :, f] = np.bincount(passed["ahead"][t], weights=column, minlength=256)
        return [taps, d.sum(axis=0), passed["pooled"].T @ error, error.sum(keepdims=True)]


def train(texts: list[str], labels: list[int], epochs: int = 14, batch: int = 24, rate: float = 0.02, decay: float = 2e-4, seed: int = 5, steps: int = 700) -> Network:
    """A network fitted by Adam in at least ``epochs`` passes and ``steps`` steps; either class weighs the same.

    With rows of one class only, scores are that class's.
    """
    net, rng = Network(), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.prior[:] = 2.0 if not len(y) or y[0] else -2.0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    epochs = max(epochs, -(-steps // -(-len(y) // batch)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            passed = net.forward(*buffers(pa.array([texts[i] for i in rows], pa.string())))
            error = ((passed["score"] - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            step += 1
            speed = rate * (1 - step / (total + 1))
            for p, g, (m, v) in zip(net.params(), net.gradients(passed, error), moments, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the doc_id's digits, modulo 4, is 2. Never for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Network:
    """Learns ``labels.quality`` from at most ``sample`` rows of each class, those with the smallest hashes of doc_id.

    Ids are chosen first, so the join that fetches their texts broadcasts at most ``2 * sample`` ids. Null labels,
    held-out rows and labels without a document don't count; a repeated label or document counts once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__i"), "quality").filter(F.col("quality").isin(0, 1) & F.col("__i").isNotNull()).filter(~held_out("__i"))
    known = known.groupBy("__i").agg(F.min("quality").alias("quality"))
    have = known.join(docs.select(F.col(doc_id).cast("long").alias("__i")).distinct(), "__i", "left_semi")
    chosen = [have.filter(F.col("quality") == q).orderBy(F.xxhash64("__i"), "__i").limit(sample) for q in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(doc_id).cast("long").alias("__i"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, "__i")
    rows = rows.dropDuplicates(["__i"]).select("__i", "text", "quality").toPandas().sort_values("__i")
    return train(rows["text"].tolist(), rows["quality"].astype(int).tolist())


def score(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and score (0 to 1) of every row of ``docs``; null and empty texts score by the bias alone."""
    kinds = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = [net.forward(*buffers(part.column(0)))["score"] for part in slices(batch, "__t", SLICE)]
            yield pa.record_batch([*batch.columns[1:], pa.array(np.concatenate(scores).astype(np.float64))], [*keep, "score"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"), *keep).mapInArrow(run, kinds)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted (1 where score >= ``threshold``).

    Fits on ``labels`` and scores every row. Repeated rows have equal scores. An empty table gives no rows; without
    labels of both classes every row scores alike.
    """
    scored = score(docs, fit(docs, labels, sample), keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    net = fit(docs, labels)
    rows = packed(docs, __text=F.col("text"))
    return score(rows, net, ["__row"], "__text").filter(F.col("score") >= threshold).select("__row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("doc_id", held_out().alias("held_out"), "score", "predicted")
