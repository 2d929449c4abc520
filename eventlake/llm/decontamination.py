"""Operator 7, benchmark decontamination by template canonicalisation.

Tokens are words without the punctuation around them, in lower case. Numbers, names and units become typed placeholders, so a
question keeps its windows when its parameters change. Beside each such window goes that of the plain words, which doesn't
depend on capitals. Windows of documents and items meet in a hash join; for each document and item the matched windows of
either kind must cover most of the item within one stretch of the document. Unless the windows of plain words do so alone, the
parameters of the item must map to those of the document consistently (the same name always to the same name).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, Words, id_back, id_key, packed, row_hash, slices, table, window_hashes

#: Words that are a unit when they follow a number.
UNITS = "% percent s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mm cm m km metre metres meter meters inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons l ml litre litres liter liters gallon gallons $ usd eur dollar dollars euro euros cent cents mph kmh km/h degree degrees celsius fahrenheit w kw mw watt watts j joule joules v volt volts a amp amps hz khz mhz ghz byte bytes kb mb gb tb".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))
#: Words in a window. Templates of few words or none besides placeholders are shared by unrelated questions; that is left to
#: coverage and the consistency of slots, so that items full of names and numbers are found too.
WINDOW = 5
#: Item windows up to which their hashes go to every task as a filter (8 bytes each); beyond it, all windows are joined.
FILTER_MOST = 2_000_000

_CORE = np.ones(256, bool)  # bytes that are no punctuation at the ends of a token; those of non-ASCII letters are kept
_CORE[:48] = _CORE[58:65] = _CORE[91:97] = _CORE[123:128] = False
_CORE[[36, 37]] = True  # $ and %


class Tokens:
    """The tokens of a batch of texts, with the code that stands for each in a template."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        data = words.data
        n = len(data)
        core = _CORE[data]
        place = np.arange(n)
        after = np.minimum.accumulate(np.where(core, place, n)[::-1])[::-1] if n else place
        before = np.maximum.accumulate(np.where(core, place, -1)) if n else place
        start, end = after[words.start], before[words.end - 1] + 1
        real = start < end
        start, end = start[real], end[real]
        self.first = np.searchsorted(np.flatnonzero(real), words.first)
        stops = np.isin(data[words.end - 1], np.frombuffer(b".!?:;", np.uint8)) if n else np.zeros(0, bool)
        opens = np.ones(len(real), bool)  # words that open a sentence: their capital says nothing
        opens[1:] = stops[:-1]
        gap = np.zeros(n + 1, np.int64)
        np.cumsum(data == 10, out=gap[1:])
        opens[1:] |= gap[words.start[1:]] != gap[words.end[:-1]]
        opens[words.first[:-1][words.first[:-1] < len(real)]] = True
        opens = opens[real]
        # Capitals: A-Z, and those of two bytes that begin with 0xC3 (most letters of western European languages).
        upper = (data >= 65) & (data <= 90)
        lower = _LOWER[data]
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        upper[accent] = True
        lower[accent + 1] += 32
        data = lower
        words.data, words.start, words.end = data, start, end
        self.data, self.start, self.end = data, start, end
        self.values = words.hashes()
        digits = np.zeros(n + 1, np.int64)
        np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
        number = digits[end] > digits[start]
        second = np.minimum(start + 1 + (data[start] == 0xC3), n - 1) if n else start
        name = upper[start] & ~upper[second] & (second < end) & ~opens if n else np.zeros(0, bool)
        follows = np.zeros(len(start), bool)
        follows[1:] = number[:-1]
        follows[self.first[:-1][self.first[:-1] < len(start)]] = False
        unit = follows & np.isin(self.values, _unit_hashes())
        self.codes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.values)))
        self.slot = number | unit | name

    def windows(self, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the windows that lie within one row: all of plain words, then templates with a placeholder."""
        if len(self.values) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        slots = slots[n:] - slots[:-n]
        ends = np.repeat(self.first[1:], np.diff(self.first))
        inside = np.arange(len(slots)) + n <= ends[: len(slots)]
        plain, typed = np.flatnonzero(inside), np.flatnonzero(inside & (slots > 0))
        return np.concatenate([window_hashes(self.values, n)[plain], window_hashes(self.codes, n)[typed]]), np.concatenate([plain, typed])

    def texts(self, at: int, n: int) -> list[str]:
        """Tokens from ``at`` on, in lower case; slots are marked by a leading character that no token starts with."""
        out = []
        for i in range(at, at + n):
            said = self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace").lower()
            out.append(f"\x01{said}" if self.slot[i] else said)
        return out


_UNIT_HASHES: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        _UNIT_HASHES.append(np.sort(Words(pa.array([" ".join(UNITS)])).hashes()))
    return _UNIT_HASHES[0]


def _short(tokens: Tokens, k: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of ``k`` plain words: the first of each hash in a row or, ``alone``, those that are the whole row."""
    hashes = window_hashes(tokens.values, k)
    size = np.diff(tokens.first)
    if alone:
        places = tokens.first[:-1][size == k]
        return hashes[places], places
    row = np.repeat(np.arange(len(size)), size)[: len(hashes)]
    places = np.flatnonzero(np.arange(len(hashes)) + k <= tokens.first[1:][row])
    return hashes[places], places


def _windows(n: int, wanted: np.ndarray | None, short: range | list[int], alone: bool):
    """(id, row hash, text) to (hash, id, row hash, place, tokens, words); with ``wanted``, only those hashes.

    Windows are of ``n`` tokens and of plain words of each size in ``short`` (see :func:`_short`).
    """
    bits = 22
    sieve = None
    if wanted is not None:
        wanted = np.sort(wanted)
        sieve = np.zeros(1 << bits, bool)
        sieve[wanted >> np.uint64(64 - bits)] = True

    def found(tokens: Tokens, k: int):
        hashes, places = tokens.windows(n) if k == n else _short(tokens, k, alone)
        if wanted is not None:
            near = sieve[hashes >> np.uint64(64 - bits)]
            hashes, places = hashes[near], places[near]
            real = np.isin(hashes, wanted)
            hashes, places = hashes[real], places[real]
        rows = np.searchsorted(tokens.first, places, "right") - 1
        if k < n and len(rows):  # one place in a row says all
            order = np.lexsort((places, hashes, rows))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(rows[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
            hashes, places, rows = hashes[order[new]], places[order[new]], rows[order[new]]
        return hashes, places, rows

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                tokens = Tokens(batch.column(2))
                ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                size = np.diff(tokens.first)
                for k in (n, *short):
                    hashes, places, rows = found(tokens, k)
                    yield pa.record_batch(
                        [pa.array(hashes.view(np.int64)), pa.array(ids[rows]), pa.array(keys[rows]), pa.array((places - tokens.first[rows]).astype(np.int32)), pa.array([tokens.texts(p, k) for p in places.tolist()], pa.list_(pa.string())), pa.array(size[rows].astype(np.int32))],
                        ["__h", "__d", "__x", "place", "tokens", "words"],
                    )

    return run


def align(groups: list[dict], words: int, n: int, coverage: float = 0.6, consistency: float = 0.8) -> tuple[float, float, float, bool]:
    """Coverage, consistency of slots, share of equal tokens and whether it is a leak, of a document's best stretch for one item.

    Each group is one window that both hold: ``found`` has its places and tokens in the document (``p``, ``t``), ``asked``
    those in the item (``q``, ``u``). They are paired only inside a stretch, which is what starts at one place and is at most
    twice as long as the item, so a window that a long document repeats costs its places, not their product. A stretch is
    a leak if windows of equal tokens cover enough of the item, or if all windows do and the slots agree.
    """
    places = sorted((f["p"], k, f["t"]) for k, g in enumerate(groups) for f in g["found"])
    best = (0.0, 0.0, 0.0, False)
    upto, done = 0, -1
    for i, (at, _, _) in enumerate(places):
        if at <= done:
            continue
        upto = max(upto, i)
        while upto < len(places) and places[upto][0] < at + 2 * words + n:
            upto += 1
        pairs: dict[tuple[int, int], tuple[str, str, bool]] = {}
        plain: set[int] = set()
        once: set[int] = set()
        for p, k, t in places[i:upto]:
            if k in once:
                continue
            if not any(w.startswith("\x01") for w in t):
                once.add(k)  # nothing to compare: the window's other places in the stretch say the same
            for x in groups[k]["asked"]:
                said = [(u.lstrip("\x01"), w.lstrip("\x01"), u.startswith("\x01")) for u, w in zip(x["u"], t, strict=True)]
                pairs.update({(x["q"] + j, p + j): y for j, y in enumerate(said)})
                if all(u == w for u, w, _ in said):
                    plain.update(range(x["q"], x["q"] + len(said)))
        covered = len({q for q, _ in pairs}) / words
        if covered > best[0] or not best[3]:
            same = len({q for (q, _), (u, t, _) in pairs.items() if u == t})
            # Each value of the item takes the value that it mostly has in the document, and no two the same.
            votes = defaultdict(Counter)
            for u, t, slot in pairs.values():
                if slot:
                    votes[u][t] += 1
            total = sum(sum(c.values()) for c in votes.values())
            taken: set[str] = set()
            agreed = 0
            for counter in sorted(votes.values(), key=lambda c: -max(c.values())):
                value, count = next(((v, c) for v, c in counter.most_common() if v not in taken), (None, 0))
                agreed += count
                taken.add(value)
            agree = agreed / total if total else 1.0
            leak = len(plain) / words >= coverage or covered >= coverage and agree >= consistency
            if (leak, covered) > (best[3], best[0]):
                best = (covered, agree, same / words, leak)
        if best[3] and best[0] >= 1:
            break
        done = at + words // 2  # the next stretch starts half an item on
    return best


def _judge(n: int, coverage: float, consistency: float):
    def run(batches):
        for batch in batches:
            rows = [align(matches, words, n, coverage, consistency) for matches, words in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            keep = [i for i, r in enumerate(rows) if r[3]]
            kind = ["exact" if rows[i][2] >= 0.95 * rows[i][0] else "re-parameterised" for i in keep]
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*picked.columns[:3], *[pa.array([rows[i][k] for i in keep], pa.float64()) for k in range(3)], pa.array(kind, pa.string())], ["__d", "__x", "__item", "coverage", "consistency", "equal", "kind"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = 0.6, consistency: float = 0.8, filter_most: int = FILTER_MOST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (__d, __x, item_id, coverage, consistency, equal, kind) for each document and item that it leaks.

    ``coverage``: share of the item's tokens inside matched windows of one stretch of the document. It is met by any text
    whose shingle similarity to the item is 0.8, and by items in which a few words were changed. ``consistency``: share
    of slots that agree with one mapping of the item's values; ignored where windows of equal words cover enough by themselves. ``kind``: exact,
    or re-parameterised where more than 5 % of the covered tokens differ.

    Null or empty text or item: no windows, no leak. Items of fewer than ``n`` tokens are one window of plain words, and any
    text that holds these in a row leaks them: who doesn't want that for items of a common word leaves them out of
    ``benchmark``. Null doc_id: __d is ``NULL_ID``; __x, a hash of the text, tells such rows apart. Null item_id: the item
    counts like others, and item_id is null. Repeated rows give one result; an item_id with several texts is judged by each
    text, with a row for each that leaks. Extra columns are not read.

    Scale: windows of documents are made where they lie and only those of the items leave the task, while the items'
    windows number at most ``filter_most``; beyond that all windows are joined, with the same result. An item that very
    many documents leak is split by Spark in the join; groups are one document and item each, and grow with the places of
    shared windows in the two, not with their product. doc_id and item_id must be numbers or strings of digits. Very long
    texts: whole, but a text has to fit in a task's memory some 40 times. Empty tables give no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(id_key(doc_id).alias("__d"), row_hash(body).alias("__x"), body.alias("text"))
    asking = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(id_key("item_id").alias("__d"), row_hash(asking).alias("__x"), asking.alias("text"))
    kind = "__h long, __d long, __x long, place int, tokens array<string>, words int"
    asked = items.mapInArrow(_windows(n, None, range(1, n), True), kind)
    short = sorted(k for (k,) in asked.filter(F.col("words") < n).select("words").distinct().collect())
    hashes = asked.select("__h").distinct().limit(filter_most + 1).toPandas()["__h"].to_numpy(np.int64).view(np.uint64)
    found = whole.mapInArrow(_windows(n, hashes if len(hashes) <= filter_most else None, short, False), kind)
    found = found.groupBy("__h", "__d", "__x").agg(F.collect_set(F.struct(F.col("place").alias("p"), F.col("tokens").alias("t"))).alias("found"))
    wanted = asked.groupBy("__h", F.col("__d").alias("__item"), F.col("__x").alias("__y"), "words").agg(F.collect_set(F.struct(F.col("place").alias("q"), F.col("tokens").alias("u"))).alias("asked"))
    # Both sides come together once for each window, whatever its repeats in the document or in the item.
    met = found.join(wanted, "__h").groupBy("__d", "__x", "__item", "__y").agg(F.max("words").alias("words"), F.collect_list(F.struct("found", "asked")).alias("matches"))
    judged = met.mapInArrow(_judge(n, coverage, consistency), "__d long, __x long, __item long, coverage double, consistency double, equal double, kind string")
    return judged.select("__d", "__x", id_back("__item").alias("item_id"), "coverage", "consistency", "equal", "kind")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item."""
    bad = leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select("__d", "__x").distinct()
    rows = packed(docs, __d=id_key(doc_id), __x=row_hash(text))
    return rows.join(bad, ["__d", "__x"], "left_anti").select("__row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(id_back("__d").alias("doc_id"), "item_id", "coverage", "consistency", "equal", "kind")
