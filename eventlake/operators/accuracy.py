"""Events against what they should be: typed leaves, accuracy by source, and vectors that sources must reproduce."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import Source
from .normalize import envelope, normalize

#: First parts of paths, and whole paths, that say how an event came about rather than what happened.
ASIDE, DERIVED = ("unmapped", "lineage", "metadata", "message"), ("type_uid", "category_uid")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _leaves(documents: pd.Series) -> pd.Series:
    def walk(value, path: str, out: dict) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k, out)
        elif value is not None:
            out[path] = json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def one(text):
        try:
            document = json.loads(text)
        except (ValueError, RecursionError):
            return None
        out: dict = {}
        if isinstance(document, dict):
            walk(document, "", out)
        return out

    return documents.map(one, na_action="ignore")


def leaves(document: Column) -> Column:
    """The leaves of a JSON object by dotted path, each as JSON, so that 1, 1.0 and "1" differ. Null leaves count as absent."""
    return _leaves(document)


def comparable(found: Column) -> Column:
    """Those leaves that accuracy is judged by."""
    return F.map_filter(found, lambda k, v: ~F.split_part(k, F.lit("."), F.lit(1)).isin(*ASIDE) & ~k.isin(*DERIVED) | (k == "metadata.original_time"))


def accuracy(pairs: DataFrame, by: str, want: str, got: str) -> DataFrame:
    """Precision, recall and F1 over typed leaves, and lines that agree wholly, for each value of ``by`` and for ALL.

    ``want`` and ``got`` are maps of leaves as :func:`leaves` gives them.
    """
    agreed = F.size(F.map_filter(want, lambda k, v: F.coalesce(F.try_element_at(got, k) == v, F.lit(False))))
    base = pairs.select(F.col(by).cast("string").alias("g"), agreed.alias("tp"), F.size(got).alias("made"), F.size(want).alias("truth"))
    whole = (F.col("tp") == F.col("truth")) & (F.col("tp") == F.col("made"))
    sums = base.rollup("g").agg(F.sum("tp").alias("tp"), F.sum("made").alias("made"), F.sum("truth").alias("truth"), F.count("*").alias("lines"), F.count_if(whole).alias("perfect_lines"), F.grouping("g").alias("all"))
    p, r = F.coalesce(F.try_divide("tp", "made"), F.lit(1.0)), F.coalesce(F.try_divide("tp", "truth"), F.lit(1.0))
    return sums.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("g")).alias("part"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), "lines", "perfect_lines")


def vector_failures(vectors: DataFrame, sources: list[Source], received_ms: int) -> DataFrame:
    """Where sources don't give what their vectors say: (name, path, expected, got), empty if all do.

    ``vectors`` has name, line and expect, a map from path to JSON. Every vector is normalised in one pass at one receive
    time; a line that no source takes has no leaves, so that all of its expectations fail.
    """
    raw = envelope(vectors.withColumn("__recv", F.lit(received_ms)), "line", "name", "__recv")
    made = normalize(raw, sources).select(F.regexp_replace("event_id", ":0$", "").alias("name"), leaves(F.col("event")).alias("got"))
    asked = vectors.select("name", F.explode("expect").alias("path", "expected"))
    both = asked.join(made, "name", "left").select("name", "path", "expected", F.try_element_at("got", F.col("path")).alias("got"))
    return both.filter(~F.col("expected").eqNullSafe(F.col("got")))
