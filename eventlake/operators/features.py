"""Windowed behaviour features, robust scores, isolation forest and findings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import bucket, millis
from ..session import cut
from .stats import medians, nearest_rank

# Features and the least scale of each, in their order.
FEATURES = ("conn_count", "uniq_dst_ip", "uniq_dst_port", "deny_ratio", "bytes_out_sum", "auth_fail_count", "uniq_sources")
FLOORS = (0.5, 0.5, 0.5, 0.15, 0.75, 0.5, 0.5)
#: Features that are not taken on a logarithmic scale.
RATIOS = frozenset(["deny_ratio"])


def project(gold: DataFrame) -> DataFrame:
    """What features need of a lake row; rows without source address or time are left out."""
    status = F.get_json_object("event", "$.status_id").try_cast("int")
    return gold.filter(F.col("src_ip").isNotNull() & F.col("time").isNotNull()).select(
        millis(F.col("time")).alias("t_ms"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("dst_port").alias("dport"), F.col("class_uid").alias("cls"),
        ((F.col("class_uid") == 4001) & (F.col("action_id") == 2)).alias("deny"), F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"), ((F.col("class_uid") == 3002) & (status == 2)).alias("auth_fail"), F.col("source_id").alias("source"), F.col("raw_ref").alias("ref"),
    )


def windows(rows: DataFrame, step: int = 60_000, evidence: int = 20) -> DataFrame:
    """The features of each source address and window of ``step`` milliseconds.

    Evidence, the first ``evidence`` suspicious rows in order of time and reference, is kept bounded while it is
    aggregated: rows are ranked within a window first, so no list is longer.
    """
    rows = rows.withColumn("window_start", bucket(F.col("t_ms"), step))
    suspicious = F.coalesce(F.col("deny"), F.lit(False)) | F.coalesce(F.col("auth_fail"), F.lit(False)) | (F.col("bytes_out") > 0)
    conn = F.col("cls") == 4001
    out = rows.groupBy("src", "window_start").agg(
        F.count_if(conn).alias("conn_count"), F.count_distinct("dst").alias("uniq_dst_ip"), F.count_distinct("dport").alias("uniq_dst_port"), (F.count_if(F.col("deny")) / (F.count_if(conn) + 4)).alias("deny_ratio"), F.sum("bytes_out").alias("bytes_out_sum"), F.count_if("auth_fail").alias("auth_fail_count"), F.count_distinct("source").alias("uniq_sources"), F.count("*").alias("events")
    )
    if not evidence:
        return out
    order = Window.partitionBy("src", "window_start").orderBy("t_ms", "ref")
    first = rows.filter(suspicious).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= evidence)
    refs = first.groupBy("src", "window_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "ref"))), lambda x: x["ref"]).alias("refs"))
    return out.join(refs, ["src", "window_start"], "left")


def vector(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each feature as ``v_<name>``: log(1 + x), ratios as they are."""
    return df.select("*", *[(F.col(f) if f in RATIOS else F.log1p(f)).cast("double").alias(f"v_{f}") for f in features])


def centres(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """The exact median of each column and that of the distances from it; two numbers a column (see :func:`.stats.medians`)."""
    med = {r.name: r.median for r in medians(df, columns).collect()}
    away = df.select(*[F.abs(F.col(c) - F.lit(med[c]).cast("double")).alias(c) for c in columns])
    dev = {r.name: r.median for r in medians(away, columns).collect()}
    return {c: (med[c], dev[c]) for c in columns}


def robust_z(df: DataFrame, columns: list[str], floors: list[float], known: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``z_<column>``: distance from the median over 1.4826 times the median deviation (or the floor, if larger).

    Medians are exact and of the whole table, or ``known`` from :func:`centres`. Null values and columns without any value
    have null scores.
    """
    known = known or centres(df, columns)
    scaled = []
    for c, floor in zip(columns, floors, strict=True):
        med, dev = (F.lit(x).cast("double") for x in known[c])
        scaled.append(((F.col(c) - med) / F.greatest(dev * 1.4826, F.lit(float(floor)))).alias(f"z_{c}"))
    return df.select("*", *scaled)


def baselines(known: dict[str, tuple[float | None, float | None]], features: tuple[str, ...] = FEATURES) -> dict[str, float | None]:
    """What is usual for each feature, on its own scale: the median of ``v_<feature>`` carried back from the logarithm."""
    found = {f: known[f"v_{f}"][0] for f in features}
    return {f: m if m is None or f in RATIOS else math.expm1(m) for f, m in found.items()}


def c_factor(m: int) -> float:
    """Mean path length of an unsuccessful search in a tree of ``m`` points."""
    return 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m


class Forest:
    """An isolation forest (Liu, Ting and Zhou 2008): trees of random splits as flat arrays, scored level by level."""

    def __init__(self, points: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(points))
        self.trees = [self._grow(points[rng.choice(len(points), self.size, replace=False)], rng) for _ in range(trees)] if len(points) else []

    def _grow(self, points: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, left, depth = [], [], [], []
        limit = math.ceil(math.log2(max(2, self.size)))
        queue = [(points, 0)]
        at = 0
        while at < len(queue):
            rows, level = queue[at]
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if level >= limit or not len(spread):
                feature.append(-1)
                cut.append(0.0)
                left.append(-1)
                depth.append(level + c_factor(len(rows)))
            else:
                f = int(rng.choice(spread))
                x = rng.uniform(rows[:, f].min(), rows[:, f].max())
                feature.append(f)
                cut.append(x)
                left.append(len(queue))
                depth.append(0.0)
                queue += [(rows[rows[:, f] < x], level + 1), (rows[rows[:, f] >= x], level + 1)]
            at += 1
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        for feature, cut, left, depth in self.trees:
            node = np.zeros(len(points), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node[rows] = left[node[rows]] + (points[rows, f[rows]] >= cut[node[rows]])
            total += depth[node]
        return 2 ** (-(total / max(1, len(self.trees))) / max(c_factor(self.size), 1e-9))


def fit_forest(df: DataFrame, columns: list[str], sample: int = 20_000, seed: int = 7, key: tuple[str, ...] = ("src", "window_start")) -> Forest:
    """A forest from at most ``sample`` rows, chosen by a hash of their ``key``: equal rows are as frequent in it as in ``df``.

    Trees take 256 of them each.
    """
    rows = df.select(*columns, F.xxhash64(*key, F.lit(seed)).alias("__h"), F.struct(*key).alias("__k")).orderBy("__h", "__k").limit(sample).select(*columns).toPandas()
    return Forest(rows.to_numpy(float), seed=seed)


def score_forest(df: DataFrame, forest: Forest, columns: list[str]) -> DataFrame:
    """``score`` in (0, 1], higher being stranger. The trees go to the tasks with the function, some 100 KB each hundred."""

    @F.pandas_udf("double")
    def scored(*values: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([v.to_numpy(float) for v in values])))

    return df.withColumn("score", scored(*columns))


def flag(df: DataFrame, threshold: float, z_columns: list[str]) -> DataFrame:
    """``zmax``, the three largest z scores, and ``flagged``: a high score with a z of 4, or a z of 7 by itself."""
    top = F.slice(F.sort_array(F.array(*[F.struct(F.col(c).alias("z"), F.lit(c.removeprefix("z_").removeprefix("v_")).alias("feature")) for c in z_columns]), asc=False), 1, 3)
    zmax = F.greatest(*[F.col(c) for c in z_columns])
    return df.withColumn("zmax", zmax).withColumn("top", top).withColumn("flagged", ((F.col("score") >= threshold) & (F.col("zmax") >= 4)) | (F.col("zmax") >= 7))


def order_statistic(df: DataFrame, column: str, share: float) -> float:
    """The value at index ``int(n * share)`` of the sorted column; counted by distinct value, not gathered."""
    return nearest_rank(df, column, [share]).first()[0]


def findings(scored: DataFrame, model: str, usual: dict[str, float | None] | None = None) -> DataFrame:
    """Flagged windows as findings: a stable id, a severity, reasons, references to evidence and, of each feature, what is ``usual``."""
    uid = F.substring(F.sha2(F.concat_ws("|", "src", F.col("window_start").cast("string"), F.lit(model)), 256), 1, 20)
    reasons = F.transform(F.filter("top", lambda t: t["z"] > 0), lambda t: F.format_string("%s z=%.1f", t["feature"], t["z"]))
    held = {f: round(m, 3) for f, m in (usual or {}).items() if m is not None}
    usual_map = F.create_map(*[F.lit(x) for pair in held.items() for x in pair]).cast("map<string,double>") if held else F.lit(None).cast("map<string,double>")
    return scored.filter("flagged").select(uid.alias("event_id"), F.lit(2004).alias("class_uid"), F.timestamp_millis("window_start").alias("time"), F.col("src").alias("src_ip"), F.when(F.col("score") > 0.7, 4).otherwise(3).alias("severity_id"), "score", reasons.alias("reasons"), "refs", usual_map.alias("baselines"))


def analyze(gold: DataFrame, known: DataFrame | None = None, model: str = "iforest-1", step: int = 60_000, contamination: float = 0.02, least_windows: int = 30) -> DataFrame:
    """New findings of a lake: windows, forest, robust scores, flags, without those already ``known`` by event_id.

    Windows are made once and so are their scores; each is kept at a checkpoint. Fewer than ``least_windows`` give no findings.
    """
    made = cut(vector(windows(project(gold), step)))
    columns = [f"v_{f}" for f in FEATURES]
    zs = [f"z_{c}" for c in columns]
    if made.limit(least_windows).count() < least_windows:
        empty = made.limit(0).select("*", *[F.lit(0.0).alias(z) for z in zs], F.lit(0.0).alias("score"))
        return findings(flag(empty, 1.0, zs), model)
    centre = centres(made, columns)
    scored = cut(robust_z(score_forest(made, fit_forest(made, columns), columns), columns, list(FLOORS), centre))
    threshold = order_statistic(scored.select("score"), "score", 1 - contamination)
    out = findings(flag(scored, threshold, zs), model, baselines(centre))
    return out if known is None else out.join(known.select("event_id"), "event_id", "left_anti")
