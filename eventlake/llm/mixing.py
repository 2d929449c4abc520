"""Operator 3, mixing sources to target weights by Pareto order sampling.

Each document is due ``target / size of its source`` copies. The whole part is allocated for certain; for the rest, documents
are ranked within their source by random odds over inclusion odds (Rosen's Pareto order sampling) and the first of them, up to
the words that the source still lacks, get one copy more. The cut is found from a histogram of the ranks: only one thin slice
of each source is ever sorted, so that no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, id_back, id_key, packed, table

#: Slices of the rank's logarithm: one is 1/500 wide, so it holds about 0.05 % of a source's documents at most.
SLICES_A_UNIT, SLICES = 500, 20_000


def _source_key(source: str) -> Column:
    """Joins treat a null source as one source like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``__k``, source_size and target of each source, from rows of (source, __k, size).

    Sources by code point, null last, weigh ``weights``, repeating, and share all sizes; a target stops at ``most``
    times its source's size and the excess is shared again by weight. In order of ``most * size / weight`` the sources
    that stop form a prefix, so running sums give the result in closed form. One row a source: small beside the input.
    """
    by = sizes.groupBy("__k").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    by = by.select("__k", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = by.withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", "__k").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first source whose ratio reaches its level is the first that doesn't stop; its level holds for all after it.
    by = by.withColumn("free", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "__k", "level"))).over(whole))
    target = F.when(F.col("ratio") >= F.col("free.level"), F.col("w") * F.col("free.level")).otherwise(F.col("cap"))
    return by.select("__k", "source_size", target.alias("target"))


#: Sources up to which their cuts are sent to every task (some 100 bytes each); beyond it the join shuffles.
BROADCAST_MOST = 100_000


class Mix:
    """Target weights and random order of a mix; ``copies`` is the whole operator, the other methods are its steps.

    ``weight``: a column of positive numbers that makes inclusion unequal within a source as well; without it, all
    documents of a source are due the same number of copies. No document gets more than ``most`` copies. A source's
    taken words miss its target by half a document at most, unless ``weight`` together with ``most`` rules that out.

    The random numbers are hashes of seed and doc_id: reruns agree, whatever the partitions. Null text: size 0. Null
    source: a source of its own, last in order. A source without words has target 0. Rows with equal doc_id, source and
    size are taken together or not at all. Columns that aren't named are not read.
    """

    def __init__(self, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7, source: str = "source", text: str = "text", doc_id: str = "doc_id", weight: str | None = None):
        self.weights, self.most, self.seed, self.weight = weights, most, seed, weight
        self.source, self.text, self.doc_id = source, text, doc_id

    def facts(self) -> dict[str, Column]:
        """What of a row decides: id, source, size, random bits and weight."""
        words = F.regexp_count(F.coalesce(F.col(self.text), F.lit("")), F.lit(WORD)).cast("long")
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), id_key(self.doc_id).cast("string"))), 1, 13), 16, 10).cast("long")
        weight = F.coalesce(F.col(self.weight).cast("double"), F.lit(0.0)) if self.weight else F.lit(1.0)
        return {"__d": id_key(self.doc_id), "source": F.col(self.source).cast("string"), "__k": _source_key(self.source), "size": words, "__h": bits, "__w": weight}

    def ranked(self, rows: DataFrame) -> DataFrame:
        """``rows`` joined to their source's target, with certain copies and, for documents that may get one more, the rank."""
        share = F.col("target") / F.col("source_size") * F.coalesce(F.col("__w") / F.col("__mean"), F.lit(0.0))
        due = rows.withColumn("__due", F.when(F.col("source_size") > 0, F.least(share, F.lit(float(self.most)))).otherwise(0.0))
        due = due.withColumn("__whole", F.floor(F.col("__due") + 1e-9)).withColumn("__pi", F.greatest(F.col("__due") - F.col("__whole"), F.lit(0.0)))
        u = (F.col("__h").cast("double") + 0.5) / float(1 << 52)
        rank = F.log(u / (1 - u)) - F.log(F.col("__pi") / (1 - F.col("__pi")))
        return due.withColumn("__rank", F.when((F.col("__pi") > 1e-9) & (F.col("size") > 0), rank))

    def cuts(self, rows: DataFrame) -> DataFrame:
        """One row for each source: __k, source_size, target, __mean and the last place of its ranking that is taken."""
        targets = source_targets(rows, self.weights, self.most)
        if self.weight:
            targets = targets.join(rows.groupBy("__k").agg((F.sum(F.col("__w") * F.col("size")) / F.sum("size")).alias("__mean")), "__k")
        else:
            targets = targets.withColumn("__mean", F.lit(1.0))
        targets = cut(targets)
        due = self.ranked(_join_sources(rows, targets))
        slot = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(F.col("__rank") * SLICES_A_UNIT) + SLICES // 2)).cast("int")
        due = due.withColumn("__slice", slot)
        # Words that each source still lacks, and the slice in which the ranked words reach them.
        steps = due.groupBy("__k", "__slice").agg(F.sum(F.col("size") * F.col("__whole")).alias("certain"), F.sum("size").alias("words"), F.first("target").alias("target"))
        running = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("lack", F.col("target") - F.sum("certain").over(Window.partitionBy("__k"))).filter(F.col("__slice").isNotNull())
        steps = steps.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        edge = steps.filter(F.col("before") < F.col("lack")).groupBy("__k").agg(F.max(F.struct("__slice", "before", "lack")).alias("edge"))
        edge = cut(edge.select("__k", "edge.*"))
        # Inside that slice: rows in order until the words are reached; the row across the edge counts if that comes nearer.
        order = Window.partitionBy("__k").orderBy("__rank", "__d", "size").rowsBetween(Window.unboundedPreceding, -1)
        inside = _join_sources(due.select("__k", "__slice", "__rank", "__d", "size"), edge, ["__k", "__slice"])
        inside = inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        last = inside.filter(F.col("upto") + F.col("size") / 2 <= F.col("lack")).groupBy("__k").agg(F.max(F.struct("__rank", "__d", "size")).alias("last"))
        # Where not even the slice's first row is taken, all slices before it are.
        floor = edge.select("__k", ((F.col("__slice") - SLICES // 2) / SLICES_A_UNIT).alias("floor"))
        return targets.join(floor, "__k", "left").join(last, "__k", "left")

    def copies(self, rows: DataFrame, cuts: DataFrame) -> DataFrame:
        """``rows`` with source_size, target, copies and taken."""
        due = self.ranked(_join_sources(rows, cuts))
        extra = F.when(F.col("last").isNotNull(), F.struct("__rank", "__d", "size") <= F.col("last")).otherwise(F.col("__rank") < F.col("floor"))
        copies = (F.col("__whole") + F.coalesce(F.col("__rank").isNotNull() & extra, F.lit(False)).cast("int")).cast("int")
        return due.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def _join_sources(rows: DataFrame, sources: DataFrame, on: list[str] | str = "__k") -> DataFrame:
    """Sources are broadcast if there are few of them; otherwise Spark splits the large ones when it joins."""
    few = sources.limit(BROADCAST_MOST + 1).count() <= BROADCAST_MOST
    return rows.join(F.broadcast(sources) if few else sources, on)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size in words, source_size, target (its source's), copies and taken.

    Options and defined cases: see :class:`Mix`. Sizes are counted once; all steps read those narrow rows, not texts.
    """
    how = Mix(**options)
    rows = cut(docs.select(*[c.alias(name) for name, c in how.facts().items()]))
    return how.copies(rows, cut(how.cuts(rows))).select(id_back("__d").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them. No text is shuffled."""
    how = Mix(**options)
    cuts = cut(how.cuts(cut(docs.select(*[c.alias(name) for name, c in how.facts().items()]))))
    taken = how.copies(packed(docs, **how.facts()), cuts).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), "copies")).alias("__copy")).select("__row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
