"""A session with the settings that the library's queries assume."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "eventlake", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, and vanished files ignored while a lake is compacted."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.ignoreMissingFiles": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is unset and everything runs on one machine, a temporary folder stands in; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "eventlake-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the :func:`shared_folder` for tables that are read again; it goes when the block ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def spread(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` dealt to at least as many partitions as there are cores, and at most ``most`` rows or so to each, before costly
    work on each of its rows.

    What the scan makes of a table's files is no guide: a piece of a file holds as many rows as its largest row group, or none.
    A table that is in small enough pieces is returned as it is, but for one of few files, whose pieces may be empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // most))
    files = len(df.inputFiles())
    return df if files >= wanted else df.repartition(wanted)
