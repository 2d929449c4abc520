"""Templates of a stream's unknown lines: counted in state that is kept between batches, bounded, and loses no line.

A batch is masked and counted where its lines lie, so that a template of very many lines moves as one row a task. State holds
what is known of each template; what a batch adds goes out as rows of its own. The sum of these rows is what the batch
operator (:func:`.mining.templates`) counts over the same lines, also for templates that the state has forgotten in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import mask

#: Samples and senders that are kept of a template.
SAMPLES = 5
_PARTIAL = "bucket int, template string, n long, first_key string, last_key string, keys array<string>, lines array<string>, peers array<string>"
_CHANGE = "template string, n long, total long, first_key string, last_key string, keys array<string>, lines array<string>, peers array<string>, fresh boolean"


def _joined(a: dict, b: dict) -> dict:
    """What two parts of one template come to: the first samples by (key, line), the first senders by name."""
    shown = sorted([*zip(a["keys"], a["lines"], strict=True), *zip(b["keys"], b["lines"], strict=True)])[:SAMPLES]
    return {"n": a["n"] + b["n"], "first_key": min(a["first_key"], b["first_key"]), "last_key": max(a["last_key"], b["last_key"]), "keys": [k for k, _ in shown], "lines": [line for _, line in shown], "peers": sorted({*a["peers"], *b["peers"]})[:SAMPLES]}


def _partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if frame.empty:
            continue
        frame = frame.sort_values(["key", "line"], kind="stable")
        rows = []
        for (bucket, template), group in frame.groupby(["bucket", "template"], sort=False):
            peers = sorted(set(group["peer"].dropna()))[:SAMPLES]
            rows.append((bucket, template, len(group), group["key"].iloc[0], group["key"].iloc[-1], group["key"].iloc[:SAMPLES].tolist(), group["line"].iloc[:SAMPLES].tolist(), peers))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARTIAL.split(", ")])


class _Templates(StatefulProcessor):
    """State of one bucket: total and keys of each template, at most ``most``; the one that was seen longest ago goes first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("templates", "template string", "total long, first_key string, last_key string, seen long")
        self.batches = handle.getValueState("batches", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        self.batches.update((now,))
        found: dict[str, dict] = {}
        for frame in rows:
            for row in frame.to_dict("records"):
                mine = {k: list(row[k]) if k in ("keys", "lines", "peers") else row[k] for k in ("n", "first_key", "last_key", "keys", "lines", "peers")}
                found[row["template"]] = _joined(found[row["template"]], mine) if row["template"] in found else mine
        out = []
        for template in sorted(found):
            new = found[template]
            was = self.known.getValue((template,)) if self.known.containsKey((template,)) else None
            total = int(new["n"]) + (was[0] if was else 0)
            first, last = (min(new["first_key"], was[1]), max(new["last_key"], was[2])) if was else (new["first_key"], new["last_key"])
            self.known.updateValue((template,), (total, first, last, now))
            out.append((template, new["n"], total, first, last, new["keys"], new["lines"], new["peers"], was is None))
        held = sorted((value[3], name[0]) for name, value in self.known.iterator())
        for _, template in held[: max(0, len(held) - self.most)]:
            self.known.removeKey((template,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGE.split(", ")])

    def close(self) -> None:
        pass


def template_changes(stream: DataFrame, line: str, key: str, peer: str | None = None, most: int = 500, buckets: int = 16) -> DataFrame:
    """What each batch of ``stream`` adds to the templates of its lines.

    template_id, template, n (lines of this batch), total (since the state knows the template, this batch included),
    first_key, last_key (of ``total``), samples (struct of key and line, the first of this batch), peers (of this batch) and
    fresh (the state did not know the template). Null lines are left out; keys are compared as text.

    State holds at most ``most`` templates, dealt to ``buckets`` by a hash. Beyond its share a bucket forgets those that were
    seen longest ago, of one batch the first by text; they start anew if they come back, and nothing that was counted is
    counted again or lost. Needs RocksDB as the provider of the state store.
    """
    text = F.col(line).cast("string")
    rows = stream.filter(text.isNotNull()).select(mask(text).alias("template"), text.alias("line"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), (F.col(peer).cast("string") if peer else F.lit(None).cast("string")).alias("peer"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("template"), F.lit(buckets)).cast("int"))
    made = rows.mapInPandas(_partials, _PARTIAL).groupBy("bucket").transformWithStateInPandas(_Templates(max(1, most // buckets)), outputStructType=_CHANGE, outputMode="Append", timeMode="None")
    samples = F.arrays_zip(F.col("keys").alias("key"), F.col("lines").alias("line")).alias("samples")
    return made.select(F.substring(F.sha2("template", 256), 1, 16).alias("template_id"), "template", "n", "total", "first_key", "last_key", samples, "peers", "fresh")


def write_changes(changes: DataFrame, root: str, once: bool = False) -> StreamingQuery:
    """Writes each batch of :func:`template_changes` below ``root``, in a folder that a replayed batch replaces."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch_id={batch_id}")

    writer = changes.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def clusters(changes: DataFrame) -> DataFrame:
    """All templates of a table of changes: n, share, first and last key, the first samples by (key, line), the first senders."""
    counts = changes.groupBy("template_id", "template").agg(F.sum("n").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    # A batch holds few samples of a template, but there may be very many batches: only each task's first ones meet.
    total = counts.agg(F.sum("n").alias("__all"))
    shown = _first(changes.select("template_id", F.explode("samples").alias("x")), "samples")
    peers = _first(changes.select("template_id", F.explode("peers").alias("x")).distinct(), "peers")
    out = counts.crossJoin(F.broadcast(total)).join(shown, "template_id", "left").join(peers, "template_id", "left")
    return out.select("template_id", "template", "n", (F.col("n") / F.col("__all")).alias("share"), "first_key", "last_key", "samples", F.coalesce("peers", F.array().cast("array<string>")).alias("peers"))


def _first(items: DataFrame, name: str) -> DataFrame:
    """The ``SAMPLES`` smallest items of each template; a window of a rank limit keeps no more than that in any task."""
    ranked = items.withColumn("__i", F.row_number().over(Window.partitionBy("template_id").orderBy("x"))).filter(F.col("__i") <= SAMPLES)
    return ranked.groupBy("template_id").agg(F.array_sort(F.collect_list("x")).alias(name))
