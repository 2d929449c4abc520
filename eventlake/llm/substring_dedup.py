"""Operator 6, substring dedup: relative Lempel-Ziv parsing of each document against all documents before it.

The reference is the whole corpus, cut into blocks of ``window`` words. A block is indexed under its anchor, the smallest
hash of the short word runs inside it, so that equal blocks meet whatever their places; only blocks whose anchor occurs in
several documents are looked up at all. The index gives, for a place of a document, the first document that holds the same
block and where it does. The greedy parse then takes the block's words as a factor and goes on as long as the next place
continues in the same reference, word by word; where the reference changes, or breaks off, the next factor begins at the
first word that the last one doesn't hold. Blocks that lie across such a boundary have lookups of their own, so what they
share with a third document is a factor too. Factors don't overlap, and what they hold is what goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, id_back, id_key, range_hashes, slices, table, window_hashes

#: Words in the runs whose hashes serve as anchors.
RUN = 8


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, in log2(width) passes."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _blocks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the anchor of the block at each word of the slice, and whether that block lies in one row."""
    hashes, run = words.hashes(), min(RUN, window)
    if len(hashes) < window:
        return hashes, np.zeros(0, np.uint64), np.zeros(0, bool)
    anchors = sliding_min(window_hashes(hashes, run), window - run + 1)
    ends = np.repeat(words.first[1:], words.counts())
    return hashes, anchors, np.arange(len(anchors)) + window <= ends[: len(anchors)]


def _runs(window: int):
    """Runs of blocks with one anchor: (anchor, hash of the run's words, id, row key, first block, blocks)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column(2))
                hashes, anchors, inside = _blocks(words, window)
                places = np.flatnonzero(inside)
                rows = np.searchsorted(words.first, places, "right") - 1
                found = anchors[places]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
                begin = np.flatnonzero(new)
                count = np.diff(np.concatenate([begin, [len(found)]]))
                start, rows = places[begin], rows[begin]
                ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                texts = range_hashes(hashes, start, start + count + window - 1)
                yield pa.record_batch(
                    [pa.array(found[begin].view(np.int64)), pa.array(texts.view(np.int64)), pa.array(ids[rows]), pa.array(keys[rows]), pa.array((start - words.first[rows]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["__a", "__r", "__d", "__x", "pos", "n"],
                )

    return run


def _lookups(window: int):
    """Single blocks under the anchors that a row lists: (block hash, id, row key, place)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column(2))
                hashes, anchors, inside = _blocks(words, window)
                blocks = window_hashes(hashes, window)
                asked = batch.column(3)
                values, offsets = asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))])
                hit = np.zeros(len(anchors), bool)
                for i in range(batch.num_rows):
                    a, b = words.first[i], min(words.first[i + 1], len(anchors))
                    if b > a:
                        hit[a:b] = np.isin(anchors[a:b], values[offsets[i] : offsets[i + 1]])
                places = np.flatnonzero(hit & inside)
                rows = np.searchsorted(words.first, places, "right") - 1
                ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield pa.record_batch([pa.array(blocks[places].view(np.int64)), pa.array(ids[rows]), pa.array(keys[rows]), pa.array((places - words.first[rows]).astype(np.int32))], ["__b", "__d", "__x", "pos"])

    return run


def factors(places: np.ndarray, refs: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First word, words, reference and first word in the reference of each factor, from the places with a block, in order.

    A place's block is at word ``at`` of document ``refs``. A factor is as long as places follow each other along one
    reference; what it shares with the factor before it is taken off its front.
    """
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (refs[1:] != refs[:-1]) | (np.diff(at) != 1)]))
    last = np.concatenate([begin[1:], [len(places)]]) - 1
    start, end = places[begin], places[last] + window
    # Ends grow along the parse, so the end of the factor before is where this one may begin.
    shift = np.maximum(np.concatenate([[0], end[:-1]]) - start, 0)
    return start + shift, end - start - shift, refs[begin], at[begin] + shift


def _parse(window: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits, n_words, n_removed, kept, spans = batch.column(2), [], [], [], []
            values, lengths = hits.flatten(), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            all_places, all_counts, all_refs, all_at = (values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            at = 0
            for text, n in zip(texts, lengths, strict=True):
                words = text.encode().split()
                n_words.append(len(words))
                found: list[dict] = []
                removed = 0
                if n:
                    long = all_counts[at : at + n].astype(np.int64)
                    step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                    places, first = np.unique(step + np.repeat(all_places[at : at + n], long), return_index=True)
                    parsed = factors(places, np.repeat(all_refs[at : at + n], long)[first], (step + np.repeat(all_at[at : at + n], long))[first], window)
                    found = [{"start": a, "words": b, "reference": c, "position": d} for a, b, c, d in zip(*(x.tolist() for x in parsed), strict=True)]
                    removed = int(parsed[1].sum())
                    stays, upto = [], 0
                    for f in found:
                        stays += words[upto : f["start"]]
                        upto = f["start"] + f["words"]
                    words = stays + words[upto:]
                    at += n
                n_removed.append(removed)
                kept.append(b" ".join(words).decode())
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("reference", pa.int64()), ("position", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["__d", "n_words", "n_removed", "kept_text", "factors"])

    return run


def drop_repeated_spans(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and factors of every row of ``docs``.

    A word goes if it lies in ``window`` consecutive words that also start in a document with a smaller doc_id. A factor
    (start, words, reference, position) says that ``words`` words from word ``start`` on are those from word ``position``
    on of document ``reference``; factors don't overlap and hold all words that go. Only those that begin at the boundary
    of another may be shorter than a window. Windows are judged on the input. Words are runs of non-space characters.

    Null or empty text: no words, kept_text empty. Texts shorter than ``window`` words stay. Null doc_id: smaller than any
    other, all such rows being one document. Repeated rows are one document and keep or lose the same words. Extra
    columns are not read. An empty table gives no rows. Blocks are compared by 64-bit hashes of word hashes. Very long
    texts: whole, but a text has to fit in a task's memory some 15 times.

    Scale: what is counted over the corpus are runs of blocks with one anchor, about 1 for 20 words. An anchor whose runs are
    equal wherever it occurs settles them at once; only where they differ, at the ends of shared passages, are single
    blocks looked up. Both are counted with partial sums, and a passage that a third of all documents share is joined
    to its first place by a join that Spark splits. Texts are shuffled once, for both joins.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(id_key(doc_id).alias("__d"), F.xxhash64(id_key(doc_id), body).alias("__x"), body.alias("text"))
    runs = whole.mapInArrow(_runs(window), "__a long, __r long, __d long, __x long, pos int, n int")
    place = F.min(F.struct("__d", "pos")).alias("__p")
    of_place = [F.col("__p.__d").alias("__ref"), F.col("__p.pos").alias("__at")]
    seen = runs.groupBy("__a").agg(place, F.max("__d").alias("__last"), (F.min("__r") != F.max("__r")).alias("__mixed")).filter("__p.__d < __last").select("__a", *of_place, "__mixed")
    shared = runs.join(seen.hint("rebalance"), "__a")
    alike = shared.filter("NOT __mixed AND __d > __ref").select("__x", F.struct("pos", "n", "__ref", "__at").alias("__hit"))
    asked = shared.filter("__mixed").groupBy("__x").agg(F.collect_set("__a").alias("__asked"))
    blocks = whole.join(asked, "__x").select("__d", "__x", "text", "__asked").mapInArrow(_lookups(window), "__b long, __d long, __x long, pos int")
    first = blocks.groupBy("__b").agg(place, F.max("__d").alias("__last")).filter("__p.__d < __last").select("__b", *of_place).hint("rebalance")
    again = blocks.join(first, "__b").filter("__d > __ref").select("__x", F.struct("pos", F.lit(1).alias("n"), "__ref", "__at").alias("__hit"))
    hits = alike.unionByName(again).groupBy("__x").agg(F.collect_list("__hit").alias("__hits"))
    parsed = whole.join(hits, "__x", "left").select("__d", "text", "__hits")
    made = parsed.mapInArrow(_parse(window), "__d long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,words:int,reference:long,position:int>>")
    return made.select(id_back("__d").alias("doc_id"), "n_words", "n_removed", "kept_text", "factors")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
