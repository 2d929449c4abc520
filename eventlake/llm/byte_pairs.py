"""Operator 11, byte-level BPE encoding and decoding in numpy matrices.

Texts are split by the tokenizer's pattern. The distinct pieces of some hundred KB of text that are no tokens themselves are
put into padded matrices, one for each power of two of lengths, and every row of a matrix merges its leftmost pair of least
rank each round. Ranks of pairs come from a hash table of (left id, right id); merged positions are squeezed out, and rows
without a pair leave the matrix. A piece of more than ``LONG`` bytes, some hundred letters without a break, takes the same
merges from a heap instead, since a round over its row for every merge would be quadratic.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, id_back, id_key, mix, ragged, table

#: Cells of one padded matrix, and pieces of one text that are held as strings at a time.
CELLS, PIECES = 1 << 18, 1 << 18
#: Pieces whose ids a process remembers, some 200 bytes each.
MEMO = 1 << 16
#: Bytes of a piece from which a round over its whole row for each merge would cost too much.
LONG = 256
# Letters and numbers of Unicode versions after 16, which the module ``regex`` knows and the tiktoken library
# doesn't. They count as unassigned when texts are split.
NEWER_LETTERS = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd \\ua7e2 \\ua7f1 \\uab6c-\\uab6d \\U000107bb-\\U000107bf"
    " \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 \\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb \\U00011df1 \\U00016ea0-\\U00016eb8 \\U00016ebb-\\U00016ed3"
    " \\U00016ff2-\\U00016ff3 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 \\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2"
    " \\U0001b123-\\U0001b128 \\U0001b168 \\U0001d6a6 \\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff \\U0001e6c0-\\U0001e6de"
    " \\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed \\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff \\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead"
    " \\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
)
NEWER_NUMBERS = "\\U00011de0-\\U00011de9 \\U0001246f \\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ff4-\\U00016ff6"
_NEWER = regex.compile("[" + (NEWER_LETTERS + NEWER_NUMBERS).replace(" ", "") + "]")
_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.uint64((1 << 64) - 1)


class Vocabulary:
    """Tokens by rank, as numpy arrays only: the bytes of all tokens, and a hash table of the pairs that make one.

    A pair makes a token if its bytes are one, whichever pair that token was made of first. Ids are ranks.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.cumsum([0, *map(len, tokens)])
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("every single byte must be a token")
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        self._fill((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), made.astype(np.int32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = (1 << max(1, 2 * len(keys)).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, _EMPTY), np.full(self.mask + 1, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == _EMPTY]
            self.keys[slot[free]] = keys[free]  # of several with one slot, the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.mask)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids makes, or the largest int32."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        out, held = self.values[slot], self.keys[slot]
        miss = held != keys
        out[miss] = _NONE
        rest = np.flatnonzero(miss & (held != _EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (held != _EMPTY)]
        return out

    def pair_rank(self, left: int, right: int) -> int:
        """:meth:`pair_ranks` of one pair, from a dictionary that a process makes when it first needs it."""
        if "_pairs" not in self.__dict__:
            held = self.keys != _EMPTY
            self._pairs = dict(zip(self.keys[held].tolist(), self.values[held].tolist(), strict=True))
        return self._pairs.get(left << 32 | right, int(_NONE))

    def encoded(self) -> dict[bytes, np.ndarray]:
        """The ids of pieces: of all tokens, and of the first pieces that this process has met beside them.

        Made anew in each process; it isn't part of what is sent to tasks, and it stops growing at ``most_encoded``.
        """
        if "_encoded" not in self.__dict__:
            data, ends, ranks = self.data.tobytes(), self.first.tolist(), np.arange(len(self.first) - 1, dtype=np.int32)
            self._encoded = {data[a:b]: ranks[i : i + 1] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a}
            self.most_encoded = len(self._encoded) + MEMO
        return self._encoded

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_encoded", "_pairs", "most_encoded")}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def _merge(ids: np.ndarray, length: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each row once no pair of it makes a token. ``ids`` is padded behind ``length``; both are overwritten."""
    out: list = [None] * len(ids)
    row, columns = np.arange(len(ids)), np.arange(ids.shape[1])
    ranks = np.full(ids.shape, _NONE, np.int32)
    r, c = np.nonzero(columns[None, :] + 1 < length[:, None])
    ranks[r, c] = vocabulary.pair_ranks(ids[r, c], ids[r, c + 1])
    while True:
        at = ranks.argmin(1)  # the leftmost of the least
        least = ranks[np.arange(len(row)), at]
        done = least == _NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i, : length[i]].copy()
            more = ~done
            if not more.any():
                return out
            width = int(length[more].max())
            ids, ranks, length, row, at, least, columns = ids[more, :width], ranks[more, :width], length[more], row[more], at[more], least[more], columns[:width]
        every = np.arange(len(row))
        ids[every, at] = least
        # The position behind the merged one is squeezed out; the pairs on both sides of the new token are looked up.
        behind = columns[None, :-1] > at[:, None]
        ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
        ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = _NONE
        length -= 1
        ranks[every, at] = _NONE
        r = np.flatnonzero(at + 1 < length)
        ranks[r, at[r]] = vocabulary.pair_ranks(ids[r, at[r]], ids[r, at[r] + 1])
        r = np.flatnonzero(at > 0)
        ranks[r, at[r] - 1] = vocabulary.pair_ranks(ids[r, at[r] - 1], ids[r, at[r]])


def _merge_long(piece: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The same for one long piece: its pairs wait in a heap by (rank, place), so that a merge costs no pass over the row."""
    ids = vocabulary.bytes[np.frombuffer(piece, np.uint8)]
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    places = np.flatnonzero(ranks != _NONE)
    heap = list(zip(ranks[places].tolist(), places.tolist(), strict=True))
    heapify(heap)
    tokens, ranks = ids.tolist(), [*ranks.tolist(), int(_NONE)]
    before, after = list(range(-1, len(tokens) - 1)), list(range(1, len(tokens) + 1))

    def renew(at: int) -> None:
        ranks[at] = vocabulary.pair_rank(tokens[at], tokens[after[at]]) if after[at] < len(tokens) else int(_NONE)
        if ranks[at] != _NONE:
            heappush(heap, (ranks[at], at))

    while heap:
        rank, at = heappop(heap)
        if ranks[at] != rank:
            continue  # one of the pair was merged before
        gone = after[at]
        tokens[at], after[at], ranks[gone] = rank, after[gone], -1
        tokens[gone] = -1
        if after[gone] < len(tokens):
            before[after[gone]] = at
        renew(at)
        if before[at] >= 0:
            renew(before[at])
    return np.array([t for t in tokens if t >= 0], np.int32)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each piece of at least one byte, merged by itself."""
    known = vocabulary.encoded()
    out: list = [known.get(piece) for piece in pieces]
    rest: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if out[i] is None:
            if len(piece) > LONG:
                out[i] = _merge_long(piece, vocabulary)
            else:
                rest.setdefault(len(piece).bit_length(), []).append(i)
    for bits, members in rest.items():
        step = max(1, CELLS >> bits)
        for at in range(0, len(members), step):
            mine = members[at : at + step]
            length = np.array([len(pieces[i]) for i in mine])
            ids = np.zeros((len(mine), int(length.max())), np.int32)
            r = np.repeat(np.arange(len(mine)), length)
            c = np.arange(len(r)) - np.repeat(np.cumsum(length) - length, length)
            ids[r, c] = vocabulary.bytes[np.frombuffer(b"".join([pieces[i] for i in mine]), np.uint8)]
            for i, found in zip(mine, _merge(ids, length, vocabulary), strict=True):
                out[i] = found
                if len(known) < vocabulary.most_encoded:
                    known[pieces[i]] = found
    return out


def _gather(number: np.ndarray, encoded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of pieces, given by their numbers, and how many each has."""
    size = np.array([len(e) for e in encoded], np.int64)
    first = np.cumsum(size) - size
    flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
    n = size[number]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(first[number], n) + at], n


def split(text: str, pattern) -> Iterator[str]:
    """The matches of ``pattern``, by the classes of Unicode 16."""
    try:
        text.encode("latin-1")  # the quickest way to see that there are none
        newer = False
    except UnicodeEncodeError:
        newer = _NEWER.search(text) is not None
    if newer:
        return (text[m.start() : m.end()] for m in pattern.finditer(_NEWER.sub("\u0378", text)))  # an unassigned one
    return (m[0] for m in pattern.finditer(text)) if len(text) > PIECES else iter(pattern.findall(text))


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each. Pieces are held for ``PIECES`` at a time."""
    count = np.zeros(len(texts), np.int64)
    ids: list[np.ndarray] = []
    number: dict[str, int] = {}
    held: list[int] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            found, n = _gather(np.array(held), encode_pieces([p.encode("utf-8", "surrogatepass") for p in number], vocabulary))
            ids.append(found)
            np.add.at(count, np.repeat([t for t, _ in owner], [k for _, k in owner]), n)
        number.clear()
        held.clear()
        owner.clear()

    for t, text in enumerate(texts):
        found = split(text, pattern)
        while some := list(islice(found, PIECES)):
            held += [number.setdefault(p, len(number)) for p in some]
            owner.append((t, len(some)))
            if len(held) >= PIECES:
                flush()
    flush()
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), count


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The bytes of the tokens, one after another; an id outside the vocabulary is an error."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(vocabulary.first) - 1):
        raise ValueError("id outside the vocabulary")
    first = vocabulary.first[ids]
    n = vocabulary.first[ids + 1] - first
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return vocabulary.data[np.repeat(first, n) + at].tobytes()


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Runs of rows of ``batch`` with about ``most`` of ``sizes``; a larger row is a run of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``: each match of ``pattern`` encoded by itself, no special tokens.

    A null text counts as empty and has no ids. Rows without doc_id keep none; repeated rows are repeated. Extra columns are
    not read. An empty table gives no rows. Texts are whole, of any length: pieces are made for some hundred thousand at a
    time, so besides the text a task holds some 4 bytes a token of it; a single piece without any break (a megabyte of
    letters, say) takes some 300 bytes a byte of it.

    Scale: rows are independent and nothing is shuffled; the vocabulary, of fixed size, goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))

    def run(batches):
        vocabulary, split = shared.value, regex.compile(pattern)
        for batch in batches:
            for part in _parts(batch, np.diff(buffers(batch.column(1))[1]), 1 << 20):
                ids, count = encode_texts([t or "" for t in part.column(1).to_pylist()], vocabulary, split)
                yield pa.record_batch([part.column(0), ragged(ids, np.concatenate([[0], np.cumsum(count)]), pa.int32())], ["__d", "ids"])

    coded = docs.select(id_key(doc_id).alias("__d"), F.col(text).alias("__t")).mapInArrow(run, "__d long, ids array<int>")
    return coded.select(id_back("__d").alias("doc_id"), "ids")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the offsets of its rows in them."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def decode(coded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the bytes that its ids stand for. Null ids give null; an id outside the vocabulary ends the job."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    names = [c for c in coded.columns if c != "decoded"]
    kinds = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in names)
    place = names.index(ids)

    def run(batches):
        for batch in batches:
            values, first = _rows(batch.column(place))
            missing = batch.column(place).is_null().to_pylist()
            made = [None if gone else decode_ids(values[a:b], shared.value) for gone, a, b in zip(missing, first[:-1], first[1:], strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.binary())], [*names, "decoded"])

    return coded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{kinds}, decoded binary")


def _digests(batches):
    for batch in batches:
        values, first = _rows(batch.column(1))
        data = values.astype("<u4")
        said = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
        back = [hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op11(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents, encoded and decoded. ``path``: the rank file; by default the one of the public tokenizers."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(coded, ranks).mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
