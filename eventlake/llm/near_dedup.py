"""Operator 10, MinHash near-dedup with tensored banding.

Two collections of ``collection`` sketches, each of ``rows`` minhashes, are computed for every distinct shingle set; each pair
of one sketch from either collection is the key of one table. ``collection ** 2`` tables thus cost ``2 * collection * rows``
minhashes instead of ``2 * collection ** 2 * rows``. Sets that share a key are candidates, and every link is confirmed on the
full shingle sets of the two texts.

Between a key and a text stands a parity sketch: bit i says whether an odd number of a set's shingles hash to i. The exclusive
or of two sketches is the sketch of the symmetric difference, so the number of its bits is a lower bound of that difference,
however large the sets. Pairs that cannot link by that bound are dropped before any text moves, without losing a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, counted, cut, id_back, id_key, mix, packed, ragged, row_hash, shingles, slices, table, window_hashes

#: At similarity 0.8, two sets miss each other in all tables with probability 2 * (1 - 0.8 ** 3) ** 12, about 4 in 10,000.
COLLECTION, ROWS = 12, 3
#: Bits of the shortest parity sketch, which rides with each token of the prefix join.
BITS = 512
#: Ids of documents with candidates up to which they are broadcast (some 32 bytes each) to leave other texts unshuffled.
BROADCAST_MOST = 2_000_000


def parity(values: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes, of at least ``BITS`` and at least twice as many bits as the set has members."""
    bits = BITS
    while bits < 2 * len(values):
        bits *= 2
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def gap(a: Column, b: Column) -> Column:
    """Bits in which two parity sketches of one length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)


def folded(a: Column) -> Column:
    """The sketch of half the bits."""
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def may_link(difference: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` members that differ in at least ``difference`` may have 100 * intersection >= percent * union."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * difference <= (100 - percent) * (n + m))


def _signatures(n: int, collection: int, rows: int):
    count = 2 * collection * rows
    rng = np.random.default_rng(20240710)
    times = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column(2), lower=True)
                hashes, first = words.hashes(), words.first
                runs = window_hashes(hashes, n)
                size, low, high = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
                sets = []
                for i in range(batch.num_rows):
                    a, b = first[i], first[i + 1]
                    found = np.unique(runs[a : b - n + 1]) if b - a >= n else shingles(hashes[a:b], n)
                    size[i], low[i], high[i] = len(found), found.sum(dtype=np.uint64), mix(found ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
                    sets.append(found)
                full = np.flatnonzero(size)
                sketches = np.zeros((batch.num_rows, count // rows), np.uint64)
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    for s in range(count // rows):
                        for k in range(s * rows, (s + 1) * rows):
                            least = np.minimum.reduceat(values * times[k] + plus[k], begin)
                            sketches[full, s] = mix(sketches[full, s] + least)
                ends = np.arange(batch.num_rows + 1) * collection
                half = sketches.view(np.int64)
                bits = [parity(x) if len(x) else np.zeros(0, np.int64) for x in sets]
                bits_end = np.concatenate([[0], np.cumsum([len(x) for x in bits])])
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(size), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), ragged(half[:, :collection].ravel(), ends, pa.int64()), ragged(half[:, collection:].ravel(), ends, pa.int64()), ragged(np.concatenate(bits) if bits else np.zeros(0, np.int64), bits_end, pa.int64())],
                    ["__d", "__x", "n_shingles", "__g1", "__g2", "__left", "__right", "__bits"],
                )

    return run


def _confirm(n: int, percent: int):
    """Of rows (a, text_a, text_b, group_a, group_b): the groups of the pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        known: tuple[int, str, np.ndarray] | None = None  # rows with the same ``a`` mostly follow each other
        for batch in batches:
            a, left = batch.column(0).to_pylist(), batch.column(1)
            keep = []
            at = 0
            for part in slices(batch, "__tb"):
                words = Words(part.column(2), lower=True)
                hashes, first = words.hashes(), words.first
                for i in range(part.num_rows):
                    text = left[at].as_py()
                    if known is None or known[0] != a[at] or known[1] != text:
                        mine = Words(pa.array([text]), lower=True)
                        known = a[at], text, shingles(mine.hashes(), n)
                    x, y = known[2], shingles(hashes[first[i] : first[i + 1]], n)
                    both = len(x) + len(y) - len(np.union1d(x, y)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(at)
                    at += 1
            yield batch.select([3, 4]).take(pa.array(keep, pa.int64()))

    return run


def texts_of(whole: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (__d, text) of ``whole`` whose id is among ``ids`` (__d).

    Up to ``BROADCAST_MOST`` ids go to the texts. Beyond that number the texts are shuffled, once, and those that are
    found are kept by a checkpoint, so that the joins that follow move no others.
    """
    ids, seen = counted(ids.distinct())
    found = whole.select("__d", "text")
    if seen["n"] <= BROADCAST_MOST:
        return found.join(F.broadcast(ids), "__d", "left_semi")
    return cut(found.join(ids, "__d", "left_semi"))


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(__ca, __cb) of the ``pairs`` (__a, __b and their groups) that link, by ``texts`` (__d, text)."""
    with_b = pairs.select("__a", "__b", "__ca", "__cb").join(texts.withColumnsRenamed({"__d": "__b", "text": "__tb"}), "__b")
    both = with_b.join(texts.withColumnsRenamed({"__d": "__a", "text": "__ta"}), "__a").select("__a", "__ta", "__tb", "__ca", "__cb")
    return both.mapInArrow(_confirm(n, percent), "__ca long, __cb long").distinct()


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (__a, __b and more) that may link by the sketches of ``sets`` (__d, __n, __bits), with the bound __gap."""
    with_b = pairs.join(sets.toDF("__b", "__nb", "__bits_b"), "__b")
    both = with_b.join(sets.toDF("__a", "__na", "__bits_a"), "__a")
    x, y = F.col("__bits_a"), F.col("__bits_b")
    # Sets of one size up to a quarter have sketches of one length up to one doubling.
    least = F.when(F.size(x) == F.size(y), gap(x, y)).when(F.size(x) > F.size(y), gap(folded(x), y)).otherwise(gap(x, folded(y)))
    close = both.filter(100 * F.least("__na", "__nb") >= percent * F.greatest("__na", "__nb")).withColumn("__gap", least)
    return close.filter(may_link(F.col("__gap"), F.col("__na"), F.col("__nb"), percent)).select(*pairs.columns, "__gap")


def looked_up(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` narrow rows, as the unique side of joins: broadcast up to ``BROADCAST_MOST`` rows.

    Beyond that it is dealt as a shuffle of its own, so that Spark can split a key that very many rows of the other side have.
    """
    return df.hint("broadcast") if n <= BROADCAST_MOST else df.hint("rebalance")


def grouped_by(nodes: DataFrame, groups: DataFrame | None, key: str = "__d", out: str = "__c") -> DataFrame:
    """``nodes`` with the group ``out`` of ``key``: its own id where no link has reached it."""
    if groups is None:
        return nodes.withColumn(out, F.col(key))
    return nodes.join(groups.toDF(key, "__found"), key, "left").withColumn(out, F.coalesce("__found", key)).drop("__found")


def link(pairs: DataFrame, whole: DataFrame, groups: DataFrame | None, n: int, percent: int) -> DataFrame | None:
    """``groups`` (__d, __c) after all links among ``pairs`` (__a, __b, __ca, __cb, __gap; __ca and __cb are their groups).

    Of the pairs between two groups, the closest by their sketches is confirmed first. Then only pairs are left whose
    groups are still apart, which are mostly none: so texts move about once for each group, however many pairs join it.
    """
    pairs, seen = counted(pairs)
    if not seen["n"]:
        return groups
    ids = pairs.select(F.col("__a").alias("__d")).unionByName(pairs.select(F.col("__b").alias("__d")))
    texts = texts_of(whole, ids)
    low, high = F.least("__ca", "__cb"), F.greatest("__ca", "__cb")
    first = F.min_by(F.struct("__a", "__b", "__ca", "__cb"), F.struct("__gap", "__a", "__b")).alias("__p")
    # While nodes are groups of their own, each takes its closest partner: there are no more pairs than nodes then, and
    # each node has one link at most, to a smaller node.
    alone = groups is None
    best, seen = counted(pairs.groupBy(*(["__b"] if alone else [low.alias("__low"), high.alias("__high")])).agg(first).select("__p.*"))
    tried = looked_up(best.select("__a", "__b"), seen["n"])
    links, seen = counted(confirmed(best, texts, n, percent))
    if seen["n"]:
        groups = merged(groups, roots(links) if alone else components(links))
    rest = pairs.join(tried, ["__a", "__b"], "left_anti").select("__a", "__b")
    rest, seen = counted(grouped_by(grouped_by(rest, groups, "__a", "__ca"), groups, "__b", "__cb").filter("__ca != __cb"))
    if not seen["n"]:
        return groups
    links, seen = counted(confirmed(rest, texts, n, percent))
    return merged(groups, components(links)) if seen["n"] else groups


def merged(groups: DataFrame | None, joined: DataFrame) -> DataFrame:
    """``groups`` (__d, __c) with whole groups joined as ``joined`` (__d, a group, and __c) says."""
    joined, seen = counted(joined)
    joined = looked_up(joined, seen["n"])
    if groups is None:
        return joined
    moved = grouped_by(groups.select("__d", F.col("__c").alias("__g")), joined, "__g", "__c").select("__d", "__c")
    both, seen = counted(moved.unionByName(joined.join(groups.select("__d"), "__d", "left_anti")))
    return looked_up(both, seen["n"])


def roots(links: DataFrame) -> DataFrame:
    """(__d, __c) for links (__ca, __cb) of which each __cb has one, to a smaller __ca: each end and the root of its tree.

    Every round doubles how far each node points, so a tree is done after log2 of its depth.
    """
    at, seen = counted(links.select(F.col("__cb").alias("__d"), F.col("__ca").alias("__c")))
    seen["moved"] = 1
    while seen["moved"]:
        up = looked_up(at.toDF("__c", "__up"), seen["n"])
        step = at.join(up, "__c", "left").select("__d", F.coalesce("__up", "__c").alias("__c"), F.col("__up").isNotNull().alias("__moved"))
        step, seen = counted(step, moved=F.count_if("__moved"))
        at = step.select("__d", "__c")
    return at.unionByName(at.select(F.col("__c").alias("__d"), "__c").distinct())


def components(links: DataFrame) -> DataFrame:
    """(__d, __c): each end of a link (__ca, __cb) and the smallest id that it reaches, by alternating large and small stars.

    Each round is a partial minimum and a join; rounds end when the links are stars, after about log2(diameter) rounds.
    Links, not documents, are what moves. Every round is cut by a checkpoint.
    """

    mark = F.sum(F.xxhash64("__a", "__b").cast("decimal(38,0)"))

    def star(edges: DataFrame, large: bool, n: int) -> DataFrame:
        low, high = F.least("__a", "__b"), F.greatest("__a", "__b")
        flat = edges.select(high.alias("__u"), low.alias("__v"))
        if large:
            flat = flat.unionByName(edges.select(low.alias("__u"), high.alias("__v")))
        least = looked_up(flat.groupBy("__u").agg(F.min("__v").alias("__m")).withColumn("__m", F.least("__m", "__u")), 2 * n)
        moved = flat.join(least, "__u")
        if large:
            return moved.filter("__v > __u").select(F.col("__v").alias("__a"), F.col("__m").alias("__b")).distinct()
        return moved.select(F.col("__v").alias("__a"), F.col("__m").alias("__b")).union(least.select("__u", "__m")).filter("__a != __b").distinct()

    edges, before = counted(links.select(F.greatest("__ca", "__cb").alias("__a"), F.least("__ca", "__cb").alias("__b")).distinct(), mark=mark)
    while before["n"]:
        once = star(edges, True, before["n"])
        edges, after = counted(star(once, False, before["n"]), mark=mark)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("__a").alias("__d"), F.col("__b").alias("__c"))
    return ends.unionByName(ends.select(F.col("__c").alias("__d"), "__c").distinct())


def _token_rows(n: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column(1), lower=True)
                hashes, first = words.hashes(), words.first
                sets = [shingles(hashes[first[i] : first[i + 1]], n) for i in range(batch.num_rows)]
                size = np.array([len(x) for x in sets], np.int64)
                rows = np.repeat(np.arange(batch.num_rows), size)
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(size[rows])], ["__t", "__d", "__n"])

    return run


def _every(step: int, at: int):
    return lambda x, i: i % step == at


def prefix_pairs(nodes: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (__a, __b, __ca, __cb) of ``nodes`` (__d, __c) with different __c that may link; no pair that does is left out.

    Exact prefix filter: with the tokens of each set in one global order, rarest first, two sets that link share one of
    the first ``size - ceil(percent % of size) + 1`` tokens of either, and at their first shared token enough tokens must be
    left in both. A token that only one set has costs nothing, so sets that merely share a common passage never meet.
    The shortest sketch of either set lies beside each token: a pair that cannot link by it is never written, so near
    copies that all stay below the threshold cost comparisons inside the join but no rows.
    """
    short, size = F.col("__bits"), F.col("__n")
    # All longs of one place modulo 8 folded together: the sketch of ``BITS`` bits.
    words = BITS // 64
    folds = [F.aggregate(F.filter(short, _every(words, k)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias(f"__s{k}") for k in range(words)]
    sketched = nodes.join(sets, "__d").select("__d", "__c", "__n", *folds)
    tokens = texts.mapInArrow(_token_rows(n), "__t long, __d long, __n long")
    often = tokens.groupBy("__t").agg(F.count("*").alias("__df")).filter("__df > 1").hint("rebalance")
    # Tokens of one set come first if no other set has them: their number is all that is needed of them.
    listed = tokens.join(often, "__t").groupBy("__d", "__n").agg(F.sort_array(F.collect_set(F.struct("__df", "__t"))).alias("__list")).join(sketched, ["__d", "__n"])
    alone = size - F.size("__list")
    prefix = size - F.ceil(size * percent / 100) + 1 - alone
    bits = [f"__s{k}" for k in range(words)]
    heads = listed.filter(prefix > 0).select("__d", "__c", "__n", *bits, alone.alias("__skip"), F.posexplode(F.slice("__list", F.lit(1), prefix.cast("int"))).alias("__i", "__e"))
    heads, _ = counted(heads.select(F.col("__e.__t").alias("__t"), "__d", "__c", "__n", (size - F.col("__skip") - F.col("__i")).alias("__left"), *bits))
    other = heads.toDF(*["__t" if c == "__t" else f"{c}2" for c in heads.columns])
    enough = (100 + percent) * F.least("__left", "__left2") >= percent * (F.col("__n") + F.col("__n2"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}2"))) for b in bits), F.lit(0))
    a, b = heads.alias("x"), other.alias("y")
    meets = (F.col("x.__t") == F.col("y.__t")) & (F.col("__d") < F.col("__d2")) & (F.col("__c") != F.col("__c2")) & enough & may_link(apart, F.col("__n"), F.col("__n2"), percent)
    met = a.join(b, meets)
    return met.select(F.col("__d").alias("__a"), F.col("__d2").alias("__b"), F.col("__c").alias("__ca"), F.col("__c2").alias("__cb")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, collection: int = COLLECTION, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A set is the distinct ``n``-word shingles of the text with A-Z in lower case; fewer words make one shingle. Sets link
    when 100 * intersection >= ``percent`` * union. component_id is the smallest doc_id that a document reaches by links.

    Null or empty text, or one of spaces only: an empty set, linked to nothing. Null doc_id: such a row has no identity;
    its text takes part as that of one document smaller than any other, but its component_id is null and kept is true
    only if nothing with an id is equal or linked to it. Repeated rows, and rows that share a doc_id, are one document.
    Extra columns are not read. An empty table gives no rows.

    Very long texts: whole, but a text has to fit in a task's memory some 15 times.

    Scale: equal sets are one node from the start. In each table every node is paired only with the smallest node that
    has the same key (a star, never all pairs), then with a random one of another group; links found so join groups of
    copies whatever their size. Where nodes of one key are still unconnected after that, an exact prefix-filter join over
    those nodes finds the links left between them, and sketches keep pairs below the threshold from being written. Only the
    recall of the tables themselves (see ``COLLECTION``) is less than 1.
    """
    out = near_groups(docs, n, percent, collection, rows, text, doc_id)
    return out.select(id_back("__d").alias("doc_id"), "n_shingles", id_back("__c").alias("component_id"), (F.col("__c") == F.col("__d")).alias("kept"))


def near_groups(docs: DataFrame, n: int, percent: int, collection: int, rows: int, text: str, doc_id: str) -> DataFrame:
    """:func:`near_duplicates` with ids as keys (__d, __c) and the hash __x of each row's text."""
    body = F.coalesce(F.col(text), F.lit(""))
    with_hash = docs.select(id_key(doc_id).alias("__d"), row_hash(text).alias("__x"), body.alias("text"))
    kind = "__d long, __x long, n_shingles long, __g1 long, __g2 long, __left array<long>, __right array<long>, __bits array<long>"
    signed = cut(with_hash.mapInArrow(_signatures(n, collection, rows), kind))
    full = signed.filter("n_shingles > 0")
    # Repeated rows are one document: their text is looked up once, not once for each repeat.
    repeats = not signed.groupBy("__d").agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty()
    whole = (with_hash.dropDuplicates(["__d", "__x"]) if repeats else with_hash).select("__d", "text")
    same = F.first(F.struct(F.col("n_shingles").alias("__n"), "__left", "__right", "__bits")).alias("__s")  # equal sets, equal sketches
    classes = cut(full.groupBy("__g1", "__g2").agg(F.min("__d").alias("__d"), same).select("__g1", "__g2", "__d", "__s.*"))
    sets = classes.select("__d", "__n", "__bits")
    table_keys = F.flatten(F.transform("__left", lambda x, i: F.transform("__right", lambda y, j: F.xxhash64(x, y, i * 1000 + j))))
    # Each row becomes ``collection ** 2``: dealt over all partitions first, as the narrow rows lie in few of them.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = classes.repartition(parts, "__d").select("__d", F.explode(table_keys).alias("__k"))
    least, _ = counted(keys.groupBy("__k").agg(F.min("__d").alias("__a"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    shared, _ = counted(keys.join(least, "__k"))
    stars = shared.filter("__d != __a").select("__a", F.col("__d").alias("__b")).distinct()
    groups = link(bounded(stars, sets, percent).withColumns({"__ca": F.col("__a"), "__cb": F.col("__b")}), whole, None, n, percent)
    # Stars around another node of each key, dealt by a hash, for what the smallest node of a key does not reach.
    left, _ = counted(mixed_keys(grouped_by(shared.select("__k", "__d"), groups)))
    centre = left.groupBy("__k").agg(F.min(F.struct(F.xxhash64("__d", "__k"), "__d", "__c")).alias("__p")).select("__k", F.col("__p.__d").alias("__a"), F.col("__p.__c").alias("__ca")).hint("rebalance")
    again = left.join(centre, "__k").filter("__c != __ca").select("__a", F.col("__d").alias("__b"), "__ca", F.col("__c").alias("__cb")).distinct()
    groups = link(bounded(again, sets, percent), whole, groups, n, percent)
    # Nodes of one key that are apart still: all links that are left between them.
    nodes, seen = counted(mixed_keys(grouped_by(left.select("__k", "__d"), groups)).select("__d", "__c").distinct())
    if seen["n"]:
        met = prefix_pairs(nodes, sets, texts_of(whole, nodes.select("__d")), n, percent)
        groups = link(bounded(met, sets, percent), whole, groups, n, percent)
    of_class = grouped_by(classes.select("__g1", "__g2", "__d"), groups).drop("__d")
    out = signed.select("__d", "__x", "n_shingles", "__g1", "__g2").join(of_class.hint("rebalance"), ["__g1", "__g2"], "left")
    return out.select("__d", "__x", "n_shingles", F.coalesce("__c", "__d").alias("__c"))


def mixed_keys(grouped: DataFrame) -> DataFrame:
    """Rows (__k, __d, __c) of the keys that hold more than one group."""
    mixed = grouped.groupBy("__k").agg(F.min("__c").alias("__low"), F.max("__c").alias("__high")).filter("__low < __high").select("__k").hint("rebalance")
    return grouped.join(mixed, "__k").select("__k", "__d", "__c")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which none is near another: the smallest doc_id of each group.

    Of rows that agree in doc_id and text one stays.
    """
    stays = near_groups(docs, n, percent, COLLECTION, ROWS, text, doc_id).filter("__c = __d").select("__d", "__x").distinct()
    rows = packed(docs, __d=id_key(doc_id), __x=row_hash(text)).join(stays, ["__d", "__x"], "left_semi")
    # Repeats fall together where they lie before anything is shuffled, so a row repeated very often is no hot key.
    return rows.dropDuplicates(["__d", "__x"]).select("__row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)
