"""Wider templates from masked ones: a tree of fixed depth whose nodes are merged level by level.

A node holds the templates of one number of words and the same first words, ``DEPTH`` of them at the leaves. Every node folds
its templates into clusters, and only those go up to its parent, so a level is a partial aggregate of the next. A node with
more members than fit in a task is folded in turns, in the order of the one fold: the members of a turn first meet the
clusters as earlier turns left them, in a task for each block of clusters, and one task then settles the turn with what each
of them agreed with most. A word that became ``<*>`` stays so, hence a cluster agrees with a member at least as well as any
earlier state of it, and the best over those states and the turn's own is the best over the present ones. So the result is
that of one fold over the whole node. Neither members nor clusters go through the driver, but for samples that fix ranges.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch
from .rows import running

#: Stands for words that differ within a cluster. Levels of words above the leaves.
WILD, DEPTH = "<*>", 2
#: Words that the members of one turn have at most, and rows that meet a block of clusters at once. How often turns double.
WORDS, SLICE, DOUBLED = 1_000_000, 256, 3
#: Characters of a template by which ranges of a large node are cut; what is sampled for that goes through the driver.
PREFIX = 256
_SCHEMA = "template string, len int, n long, parts long"
_MEMBERS = "node string, age long, template string, n long, parts long, fits int"
_FOUND = "node string, age long, score long, older long, block long, wide string"
_KNOWN = "node string, block long, age long, template string"
_CLUSTERS = "node string, block long, age long, template string, n long, parts long"


def words_of(template: Column) -> Column:
    """The runs of a template between spaces and tabs; one empty word if there are none."""
    found = F.filter(F.split(template, r"[ \t]+"), lambda w: w != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def fold(rows: list[tuple[list[str], int, int, int]], similarity: float, found: dict[int, tuple[int, int, list[str]]] | None = None) -> list[tuple[list[str], int, int, int]]:
    """Clusters (words, n, parts, age) of ``rows`` (words, n, parts, age), all of one number of words.

    In the given order each row joins the cluster that it agrees with most, if that is in at least ``similarity`` of its
    words, or starts one of its own age; the older one wins a tie. A cluster's ``<*>`` agrees with any word. ``found`` has by
    age (score, age, words) of the best among clusters made before; those that rows join come out with what they gained.
    """
    if not rows:
        return []
    number = {WILD: 0}

    def coded(words: list[str]) -> list[int]:
        return [number.setdefault(w, len(number)) for w in words]

    ids = np.array([coded(words) for words, *_ in rows], np.int32)
    earlier = {age: (score, older, coded(words)) for age, (score, older, words) in (found or {}).items()}
    wide, ages = np.empty_like(ids), np.empty(len(ids), np.int64)  # clusters so far, in the first rows
    gained: list[list[int]] = []
    for row, (_, n, parts, age) in zip(ids, rows, strict=True):
        many = len(gained)
        best, score, older, words = many, -1, age, row
        if many:
            same = ((wide[:many] == row) | (wide[:many] == 0)).sum(1)
            score = int(same.max())
            best = int(np.where(same == score, ages[:many], np.iinfo(np.int64).max).argmin())
            older = int(ages[best])
        if age in earlier and (earlier[age][0], -earlier[age][1]) > (score, -older):
            best, (score, older, words) = many, earlier[age]
        if score < similarity * ids.shape[1]:
            best, older, words = many, age, row
        if best == many:
            wide[many], ages[many] = words, older
            gained.append([0, 0])
        wide[best][wide[best] != row] = 0
        gained[best][0] += n
        gained[best][1] += parts
    name = list(number)
    return [([name[x] for x in wide[k].tolist()], n, parts, int(ages[k])) for k, (n, parts) in enumerate(gained)]


def agreed(known: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``asked`` the number of words in which it agrees with a cluster of ``known`` at most, and the first such cluster."""
    words = pa.concat_arrays([pc.split_pattern(a, " ").flatten() for a in (known, asked)]).dictionary_encode()
    codes = words.indices.to_numpy().reshape(len(known) + len(asked), -1)
    codes = codes.astype(np.int16 if len(words.dictionary) < 2**15 else np.int32)
    wild = pc.index(words.dictionary, WILD).as_py()
    many, length = len(known), codes.shape[1]
    clusters, rows = np.where(codes[:many] == wild, -1, codes[:many]).T.copy(), codes[many:]
    free = (clusters == -1).sum(0).astype(np.uint8 if length < 2**8 else np.int32)
    scores, firsts = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), SLICE):
        some = rows[at : at + SLICE]
        same, equal = np.repeat(free[None], len(some), 0), np.empty((len(some), many), bool)
        for k in range(length):
            np.equal(some[:, k, None], clusters[k], out=equal)
            np.add(same, equal.view(np.uint8), out=same)
        firsts[at : at + SLICE] = same.argmax(1)
        scores[at : at + SLICE] = same.max(1)
    return scores, firsts


def _folded(clusters: DataFrame, similarity: float) -> DataFrame:
    """The clusters of each node, each node in one task."""

    def run(batches):
        key, rows = None, []

        def folded() -> list[tuple]:
            if len(rows) == 1:
                return [(rows[0][0], len(rows[0][0].split(" ")), *rows[0][1:])]
            found = fold([(t.split(" "), n, parts, i) for i, (t, n, parts) in enumerate(rows)], similarity)
            return [(" ".join(w), len(w), n, parts) for w, n, parts, _ in found]

        for batch in batches:
            made = []
            for *row, node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node != key:
                    made += folded() if rows else []
                    key, rows = node, []
                rows.append(row)
            yield _table(made)
        yield _table(folded() if rows else [])

    near = clusters.repartition("node").sortWithinPartitions("node", F.col("n").desc(), "template")
    return near.select("template", "n", "parts", "node").mapInArrow(run, _SCHEMA)


def _table(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["template", "len", "n", "parts"])


def _level(clusters: DataFrame, depth: int, most: int, similarity: float) -> DataFrame:
    """The nodes of one level, folded. Words with a mark are no branch of the tree, as in other positions they differ."""
    words = [F.get(F.split("template", " "), F.lit(k)) for k in range(depth)]
    node = F.concat_ws(" ", "len", *[F.when(w.contains("<"), "").otherwise(F.coalesce(w, F.lit(""))) for w in words])
    clusters = clusters.withColumn("node", node)
    fits = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(WORDS) / F.col("len")))).cast("int")
    large = cut(clusters.groupBy("node", fits.alias("fits")).count().filter("count > fits").select("node", "fits"))
    if not large.limit(1).count():
        return _folded(clusters, similarity)
    # Names of large nodes, one for thousands of members, are broadcast: after a shuffle join by node, Spark would take the
    # repartition by node for done, and then may read that join's shuffle in other pieces.
    large = F.broadcast(large)
    return _folded(clusters.join(large, "node", "left_anti"), similarity).unionByName(_in_turns(clusters.join(large, "node"), similarity))


def _turn() -> Column:
    """The turn of a member: the first has ``fits``, and later ones double ``DOUBLED`` times while their words fit."""
    doubled = f"least({DOUBLED}, length(bin(greatest(fits, {WORDS} div len) div fits)) - 1)"
    nth, power = "(age div fits + 1)", f"shiftleft(1L, {doubled})"
    return F.expr(f"cast(if({nth} < {power}, length(bin({nth})), {doubled} + {nth} div {power}) - 1 as int)")


def _in_turns(members: DataFrame, similarity: float) -> DataFrame:
    """The clusters of nodes that are folded in turns, and met in blocks of ``fits`` clusters.

    Rows of one key meet after a repartition, not in a join: Spark would judge a side by its files, which are far smaller
    than the copies for each block, and take them through the driver.
    """
    spark, columns = members.sparkSession, ("node", "age", "template", "n", "parts", "fits")
    placed = running(members, ["node"], [F.col("n").desc(), F.col("template")], near=[F.col("n").desc(), F.left("template", F.lit(PREFIX))]).withColumnRenamed("__before", "age")
    with scratch(spark, "turns") as here:
        placed.select(*columns, _turn().alias("turn")).write.partitionBy("turn").parquet(f"{here}/members")
        last = spark.read.parquet(f"{here}/members").agg(F.max("turn")).first()[0]
        for turn in range(last + 1):
            members = spark.read.schema(_MEMBERS).parquet(f"{here}/members/turn={turn}")
            if turn:
                known = spark.read.schema(_KNOWN).parquet(f"{here}/known{(turn - 1) % 2}")
                members = members.join(F.broadcast(known.groupBy("node").agg(F.count("*").alias("had"))), "node")
                blocks = F.explode(F.expr("sequence(0L, (had - 1) div fits)"))
                asked = members.select("node", blocks.alias("block"), F.lit(1).alias("kind"), "age", "template")
                met = known.select("node", "block", F.lit(0).alias("kind"), "age", "template").unionByName(asked)
                found = met.repartition("node", "block").sortWithinPartitions("node", "block", "kind", "age").mapInArrow(_meeting(similarity), _FOUND)
                members = members.unionByName(found, allowMissingColumns=True)
            else:
                members = members.withColumns({"had": F.lit(0).cast("long"), **{c: F.lit(None).cast(k) for c, k in (("score", "long"), ("older", "long"), ("block", "long"), ("wide", "string"))}})
            settled = members.repartition("node").sortWithinPartitions("node", F.col("score").isNotNull(), "age").mapInArrow(_settling(similarity), _CLUSTERS)
            settled.write.parquet(f"{here}/clusters/turn={turn}")
            if turn < last:
                states = spark.read.schema(_CLUSTERS).parquet(f"{here}/clusters/turn={turn}").select("node", "block", "age", "template", F.lit(turn).alias("turn"))
                if turn:  # nodes without members in this turn have none later
                    going = F.broadcast(states.select("node").distinct())
                    states = states.unionByName(known.join(going, "node", "left_semi").withColumn("turn", F.lit(turn - 1)))
                present = states.groupBy("node", "age").agg(F.max_by(F.struct("block", "template"), "turn").alias("c"))
                present.select("node", "c.block", "age", "c.template").write.mode("overwrite").parquet(f"{here}/known{turn % 2}")
        states = spark.read.schema(f"{_CLUSTERS}, turn int").parquet(f"{here}/clusters")
        whole = states.groupBy("node", "age").agg(F.max_by("template", "turn").alias("template"), F.sum("n").alias("n"), F.sum("parts").alias("parts"))
        return cut(whole.select("template", F.size(F.split("template", " ")).alias("len"), "n", "parts"))


def _runs(batches, by: tuple[str, ...]):
    """The key of neighbouring rows with equal ``by``, and those rows; a key that goes on in the next batch comes again."""
    for batch in batches:
        at = 0
        for key, same in groupby(zip(*[batch.column(c).to_pylist() for c in by], strict=True)):
            many = sum(1 for _ in same)
            yield key, batch.slice(at, many)
            at += many


def _meeting(similarity: float):
    """For members of a turn, what they agree with most in one block of the clusters that earlier turns left."""

    def run(batches):
        at, blocks, known = None, [], None
        for (node, block, kind), rows in _runs(batches, ("node", "block", "kind")):
            if at != (node, block):
                at, blocks, known = (node, block), [], None
            if not kind:
                blocks.append(rows)
                continue
            known = known or [pa.concat_arrays([b.column(c) for b in blocks]) for c in ("age", "template")]
            asked = rows.column("template")
            scores, firsts = agreed(known[1], asked)
            enough = np.flatnonzero(scores >= similarity * len(asked[0].as_py().split(" ")))
            same = [pa.array([v] * len(enough), k) for v, k in ((node, pa.string()), (block, pa.int64()))]
            yield pa.record_batch([same[0], rows.column("age").take(enough), pa.array(scores[enough]), known[0].take(firsts[enough]), same[1], known[1].take(firsts[enough])], names=["node", "age", "score", "older", "block", "wide"])

    return run


def _settling(similarity: float):
    """The members of a turn, folded: clusters that are new or gained members, by age, with what they gained in this turn."""

    def settled(node: str, rows: list[tuple], found: dict[int, tuple], had: int, fits: int) -> pa.RecordBatch:
        best = {age: (score, -older, wide.split(" ")) for age, (score, older, _, wide) in found.items()}
        blocks = {-older: block for _, older, block, _ in found.values()}
        made = []
        for age, words, n, parts in sorted((age, words, n, parts) for words, n, parts, age in fold(rows, similarity, best)):
            if age not in blocks:
                blocks[age], had = had // fits, had + 1
            made.append((node, blocks[age], age, " ".join(words), n, parts))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["node", "block", "age", "template", "n", "parts"])

    def run(batches):
        key, rows, found, had, fits = None, [], {}, 0, 1
        for (node,), some in _runs(batches, ("node",)):
            if node != key:
                if rows:
                    yield settled(key, rows, found, had, fits)
                key, rows, found = node, [], {}
            for r in some.to_pylist():
                if r["score"] is None:
                    rows.append((r["template"].split(" "), r["n"], r["parts"], r["age"]))
                    had, fits = r["had"], r["fits"]
                else:  # members come first, then what each block has for them
                    found[r["age"]] = max(found.get(r["age"], (-1,)), (r["score"], -r["older"], r["block"], r["wide"]))
        if rows:
            yield settled(key, rows, found, had, fits)

    return run


def _met(bucket: Column, buckets: Column, turn: int) -> Column:
    """The lower of ``bucket`` and the one that it meets in this turn; in buckets - 1 (made odd) turns all have met once."""
    last = buckets + buckets % 2 - 1
    other = F.when(bucket == last, F.lit(turn)).when(bucket == turn, last).otherwise(F.pmod(2 * turn - bucket, last))
    return F.when(turn < last, F.least(bucket, other)).otherwise(bucket)


def merge(counts: DataFrame, similarity: float = 0.5, most: int = 5_000, depth: int = DEPTH) -> DataFrame:
    """(template, n, parts) of the wide templates that ``counts`` (template, n) come to; ``parts`` counts what joined.

    Words that differ within a wide template are ``<*>``. Members of a node are taken commonest first, then by text. Null
    templates are left out, repeated ones are added up, and an empty table gives no rows. No template is ever dropped:
    ``most`` only bounds what one task folds at a time (the first turn; later ones have up to eight times as many), and has
    no part in the result. Members that stay apart meet each other, so the work of a node grows with its square then; it is
    done in as many tasks as a turn's members have blocks of clusters to meet.
    """
    rows = counts.filter(F.col("template").isNotNull()).select(words_of(F.col("template")).alias("w"), "n")
    clusters = rows.groupBy(F.array_join("w", " ").alias("template"), F.size("w").alias("len")).agg(F.sum("n").alias("n")).withColumn("parts", F.lit(1).cast("long"))
    for level in range(depth, -1, -1):
        clusters = _level(cut(clusters), level, most, similarity)
    return clusters.select("template", "n", "parts")
