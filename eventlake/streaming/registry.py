"""Sources that change while a stream runs: versions in a shared folder, and the one that each batch took.

A version is written whole and never changed. A batch takes the newest one when it first begins and notes it beside its rows;
if it is replayed it takes that one again, so a replay gives the same rows whatever was published since.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators.mapping import Source
from ..sources import lake


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order; names of folders are all that is read."""
    names = lake.matching(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(n.rsplit("version=", 1)[1].split("/")[0]) for n in names)


def publish(spark: SparkSession, sources: list[Source], path: str) -> int:
    """Writes ``sources`` as the next version and returns its number. Two that publish at once: one of them fails."""
    version = max(published(spark, path), default=0) + 1
    _write(spark, sources, f"{path}/version={version}", "error")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> list[Source]:
    """The sources of a version, of the newest one if none is named; no source where none was published."""
    if version is None:
        version = max(published(spark, path), default=0)
        if not version:
            return []
    return _read(spark, f"{path}/version={version}")


def for_batches(path: str, root: str) -> Callable[[SparkSession, int], list[Source]]:
    """The sources of each batch of a stream below ``root``, for :func:`.pipeline.write_batch`."""

    def of(spark: SparkSession, batch_id: int) -> list[Source]:
        noted = f"{root}/sources/batch_id={batch_id}"
        if not lake.matching(spark, f"{noted}/_SUCCESS"):
            _write(spark, load(spark, path), noted, "overwrite")
        return _read(spark, noted)

    return of


def _write(spark: SparkSession, sources: list[Source], path: str, mode: str) -> None:
    rows = [(i, json.dumps(dataclasses.asdict(s))) for i, s in enumerate(sources)]
    spark.createDataFrame(rows, "i int, source string").coalesce(1).write.mode(mode).parquet(path)


def _read(spark: SparkSession, path: str) -> list[Source]:
    found = spark.read.schema("i int, source string").parquet(path).orderBy("i").collect()
    return [_source(json.loads(r.source)) for r in found]


def _source(said: dict) -> Source:
    """A source from JSON, whose lists stand for the tuples of predicates, rules and operations too."""
    return Source(**{k: _tuples(v) if k in ("match", "select") else v for k, v in said.items()})


def _tuples(items: list) -> list[tuple]:
    return [tuple(_tuples(x) if isinstance(x, list) else x for x in item) for item in items]
