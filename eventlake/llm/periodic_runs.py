"""Operator 13, periodic runs: stretches of words that repeat with a period, from Lyndon words.

Every run has a Lyndon root, which is the longest Lyndon word at its place in one of two opposite orders of the words (the
"runs" theorem). So the end of the longest Lyndon word at each place is found from right to left, once for each order, and
extended to both sides while words one period apart agree. Comparing and extending take the longest common extension of two
places, by binary search over rolling hashes; words are compared directly where an extension ends, and over each run found.

Before that, whole texts are narrowed to where a run can be: a run of at least 24 words and three periods repeats each of its
16-word windows, so words outside of windows that occur twice in their text belong to none. That takes numpy passes only.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, id_back, id_key, slices, table, window_hashes

#: Modulus of the rolling hash, a prime, and its bases; the second one serves where the first gave a wrong extension.
PRIME = (1 << 61) - 1
BASES = tuple(int(x) for x in np.random.default_rng(61).integers(1 << 32, 1 << 60, 4))

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "array<struct<start:long,length:long,period:long>>"


class Collision(Exception):
    """Two stretches of different words had the same hash."""


class Extensions:
    """Longest common extensions of places in a sequence of numbers."""

    def __init__(self, ids: list[int], base: int):
        self.ids, n = ids, len(ids)
        self.sums, self.powers = [0] * (n + 1), [1] * (n + 1)
        at, power = 0, 1
        for k, x in enumerate(ids, 1):
            self.sums[k] = at = (at * base + x + 1) % PRIME
            self.powers[k] = power = power * base % PRIME

    def same(self, i: int, j: int, n: int) -> bool:
        sums = self.sums
        return (sums[i + n] - sums[j + n] - (sums[i] - sums[j]) * self.powers[n]) % PRIME == 0

    def ahead(self, i: int, j: int, most: int) -> int:
        """How many words from ``i`` and ``j`` on are the same, at most ``most``."""
        ids, n = self.ids, 0
        while n < 4:  # most places part at once
            if n == most or ids[i + n] != ids[j + n]:
                return n
            n += 1
        step = 8
        while n + step <= most and self.same(i + n, j + n, step):
            n += step
            step *= 2
        low, high = 0, min(step - 1, most - n)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.same(i + n, j + n, half) else (low, half - 1)
        n += low
        if n < most and ids[i + n] == ids[j + n]:
            raise Collision
        return n

    def behind(self, i: int, j: int, most: int) -> int:
        """How many words before ``i`` and ``j`` are the same, at most ``most``."""
        ids, n = self.ids, 0
        while n < 4:
            if n == most or ids[i - n - 1] != ids[j - n - 1]:
                return n
            n += 1
        step = 8
        while n + step <= most and self.same(i - n - step, j - n - step, step):
            n += step
            step *= 2
        low, high = 0, min(step - 1, most - n)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.same(i - n - half, j - n - half, half) else (low, half - 1)
        n += low
        if n < most and ids[i - n - 1] == ids[j - n - 1]:
            raise Collision
        return n


def _scan(ids: list[int], least: int, times: int, base: int) -> set[tuple[int, int, int]]:
    n, found, both = len(ids), set(), Extensions(ids, base)
    for down in (False, True):
        ends = [0] * n  # of the longest Lyndon word at each place: the words that stack up to the right of it
        newest: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                k = ends[j]
                if ids[i] != ids[j]:
                    less = (ids[i] < ids[j]) != down
                else:
                    most = min(j - i, k - j)
                    same = both.ahead(i, j, most)
                    less = (ids[i + same] < ids[j + same]) != down if same < most else j - i < k - j
                if not less:
                    break
                j = k
            ends[i] = j
            period = j - i
            if period * times > n:
                continue
            known = newest.get(period)
            if known and known[0] <= i and j <= known[1]:
                continue  # a root inside a run of its period is one of that run
            start, end = i - both.behind(i, j, i), j + both.ahead(i, j, n - j)
            if end - start >= max(least, times * period):
                newest[period] = start, end
                found.add((start, end - start, period))
    for start, length, period in found:
        if ids[start : start + length - period] != ids[start + period : start + length]:
            raise Collision
    return found


def runs_of(ids: list[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period."""
    for base in BASES:
        try:
            return sorted(_scan(ids, least, times, base), key=lambda run: (run[0], run[2]))
        except Collision:
            continue
    raise ValueError("every base of the rolling hash has collisions")


def stretches(hashes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int]]:
    """Where runs can be: stretches of words that lie in windows which occur more than once in this text."""
    if len(hashes) < least:
        return []
    width = -(-least * (times - 1) // times)  # a run is longer than its period by that many words at least
    windows = window_hashes(hashes, width)
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return []
    again = np.zeros(len(windows), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[: len(windows)] += again
    steps[width : width + len(windows)] -= again
    inside = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def find(words: list[bytes], hashes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """The runs of one text. Words are told apart by their bytes; equal hashes only make a stretch be looked at in vain."""
    found = []
    for begin, end in stretches(hashes, least, times):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words[begin:end]]
        found += [(begin + start, length, period) for start, length, period in runs_of(ids, least, times)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def _found(least: int, times: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__t"):
                split = Words(part.column(1))
                hashes = split.hashes()
                counts, runs, kept = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = text.encode().split()  # bytes are split at just the six characters that end a word
                    mine = find(words, hashes[split.first[i] : split.first[i + 1]], least, times)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                    kept.append(collapse(words, mine).decode())
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.string())], ["__d", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, in words) and the collapsed text of every row of ``docs``.

    A run has at least ``least`` words and ``times`` (two or more) of its smallest period, and no word beside it goes on
    with the period. Collapsing drops what a run holds after its first period.

    A null or empty text has no words and no runs. Rows without doc_id keep none; repeated rows are repeated. Extra columns
    are not read. An empty table gives no rows. Texts are whole, of any length; a text has to fit in a task some 30 times,
    and its repetitive part, where runs are looked for word by word, some 200 times.

    Scale: rows are independent and nothing is shuffled. Time is near linear in the words (a text of one word repeated takes
    a logarithm more).
    """
    rows = docs.select(id_key(doc_id).alias("__d"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = rows.mapInArrow(_found(least, times), f"__d long, n_words long, runs {_RUN_DDL}, collapsed string")
    return found.select(id_back("__d").alias("doc_id"), "n_words", "runs", "collapsed")


def repeating(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten made periodic from some word on, by a hash of its doc_id; others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    bound = F.transform(F.array(words), made)[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(text)


def _digests(batches):
    for batch in batches:
        rows = []
        for runs, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            said = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
            shown = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
            rows.append((len(runs), *shown, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text")))
    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return found.select("doc_id", "runs", "collapsed").mapInArrow(_digests, kinds)
