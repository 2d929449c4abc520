"""Templates of unknown lines and types of unknown fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, time
from ..functions.text import mask
from . import template_tree


def templates(lines: DataFrame, text: str, key: str, samples: int = 5, peer: str | None = None) -> DataFrame:
    """Lines by template: id (a hash of it), lines, share of all, and the first ``samples`` lines by ``key``, if any are wanted.

    With ``peer``, also how many different senders a template has. Lines are masked once and counted with partial sums; to
    show samples, the smallest keys of each template are found first, so no template's lines are sorted or gathered.
    """
    masked = lines.filter(F.col(text).isNotNull()).select(F.col(text).alias("line"), F.col(key).alias("key"), mask(F.col(text)).alias("template"), *([F.col(peer).alias("peer")] if peer else []))
    more = [F.count_distinct("peer").alias("peers")] if peer else []
    counts = masked.groupBy("template").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), *more)
    total = masked.agg(F.count("*").alias("__all"))
    out = counts.crossJoin(F.broadcast(total)).select(F.substring(F.sha2("template", 256), 1, 16).alias("template_id"), "template", "n", (F.col("n") / F.col("__all")).alias("share"), "first_key", "last_key", *(["peers"] if peer else []))
    if not samples:
        return out
    # Rows of a template in one task are ranked there first, so at most ``samples`` of them leave it.
    ranked = masked.withColumn("__n", F.row_number().over(Window.partitionBy("template").orderBy("key", "line"))).filter(F.col("__n") <= samples)
    shown = ranked.groupBy("template").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "line"))), lambda x: x["line"]).alias("samples"))
    return out.join(shown, "template").select("template_id", "template", *[c for c in out.columns if c not in ("template_id", "template")], "samples")


def merged_templates(counts: DataFrame, similarity: float = 0.5) -> DataFrame:
    """Masked templates (template, n) joined to wider ones: (template, n, parts), words that differ being ``<*>``. See :mod:`.template_tree`."""
    return template_tree.merge(counts, similarity)


def field_types(fields: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """The type of each field, from rows of (name, value): the first whose test nearly all values pass.

    Types in order: ipv4, mac, port, int, float, iso8601, url, enum (at most 12 values in a quarter of the rows), string.
    """
    v = F.col(value)
    whole = v.rlike(r"^[+-]?\d{1,18}$")
    tests: list[tuple[str, Column, float]] = [
        ("ipv4", v.rlike(net.IPV4), 0.95),
        ("mac", v.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), 0.95),
        ("port", whole & v.try_cast("long").between(0, 65535) & F.lower(name).contains("port"), 0.95),
        ("int", whole, 0.95),
        ("float", v.rlike(r"^[+-]?\d+(?:\.\d+)?$"), 0.95),
        ("iso8601", v.rlike(time.ISO), 0.95),
        ("url", v.rlike(r"^[a-z][a-z0-9+.-]*://\S+$"), 0.9),
    ]
    shares = fields.filter(v.isNotNull()).groupBy(F.col(name).alias("name")).agg(*[F.avg(test.cast("int")).alias(f"__{t}") for t, test, _ in tests], F.count("*").alias("support"), F.count_distinct(v).alias("values"))
    kind = F.when((F.col("values") <= 12) & (F.col("values") <= F.col("support") * 0.25), "enum").otherwise("string")
    for t, _, least in reversed(tests):
        kind = F.when(F.col(f"__{t}") >= least, t).otherwise(kind)
    return shares.select("name", kind.alias("type"), "support", "values")


def majority(df: DataFrame, value: Column, by: str | None = None) -> DataFrame:
    """The commonest value (the smaller of equals), and its share."""
    counted = df.select(*([by] if by else []), value.alias("value")).groupBy(*([by] if by else []), "value").agg(F.count("*").alias("n"))
    best = counted.groupBy(*([by] if by else [])).agg(F.max(F.struct("n", F.lit(0))).alias("__m"), F.sum("n").alias("__all"), F.max("n").alias("n"))
    joined = counted.join(best.drop("__m"), [*([by] if by else []), "n"])
    return joined.groupBy(*([by] if by else []), "n", "__all").agg(F.min("value").alias("value")).select(*([by] if by else []), "value", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))
