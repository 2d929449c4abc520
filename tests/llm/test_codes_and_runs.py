"""Operators 11 to 13 on small rows, against the tiktoken library, plain loops and brute force; recall of operator 7."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from eventlake.llm import byte_pairs, decontamination, periodic_runs, queries, vector_codes

FOLDER = "/root/testdata/sf0.001"
SPACED = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- 11 byte pairs


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts, ranks):
    ids, count = byte_pairs.encode_texts(texts, byte_pairs.Vocabulary(ranks), regex.compile(public_tokenizers.PATTERN))
    ends = np.cumsum(count)
    return [ids[e - n : e].tolist() for e, n in zip(ends, count, strict=True)]


def test_encodes_as_the_library(ranks, library):
    rng = random.Random(3)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "the in on", "aA1 .\n\t", "éüñ漢字かな", "\U0001f600‍́a", "<|endoftext|> "]
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "can't've", "a" * 5000, "ab" * 3000, "\x00\x01", "　   "]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 7, 60, 300, 2000]))) for alphabet in alphabets for _ in range(40)]
    assert encoded(texts, ranks) == [library.encode_ordinary(t) for t in texts]


def test_letters_newer_than_the_library(ranks, library):
    places = [int(x, 16) for part in (byte_pairs.NEWER_LETTERS, byte_pairs.NEWER_NUMBERS) for r in part.split() for x in regex.findall("[0-9a-f]{4,}", r)]
    assert len(places) > 50
    texts = [f"ç{chr(c)}a {chr(c)}1{chr(c)}{chr(c)}." for c in places] + [f" {chr(c)}{chr(c)}a1 {chr(c)}" for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    assert encoded(texts, ranks) == [library.encode_ordinary(t) for t in texts]


def test_pairs_meet_by_their_bytes():
    # "abc" is a token that its pairs reach both as a+bc and as ab+c; a piece that is a token is taken whole ("ca").
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 301, b"cab": 298, b"zzzz": 400}
    vocabulary, library = byte_pairs.Vocabulary(ranks), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for piece in ("abc", "abcabc", "cabcab", "bcab", "zzzz", "zzzzz", "aabbcc", "abcab" * 100):
        got = byte_pairs.encode_pieces([piece.encode()], vocabulary)[0].tolist()
        assert got == library.encode_ordinary(piece)
        if len(piece) > 1 and piece.encode() not in ranks:
            assert byte_pairs._merge_long(piece.encode(), vocabulary).tolist() == got
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary({b"a": 0})


def test_byte_pairs_over_odd_rows(spark, ranks, library):
    rows = [(1, "hello world"), (1, "hello world"), (None, "x"), (None, None), (2, None), (3, ""), (4, "word " * 50_000), (5, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = byte_pairs.encode(docs, ranks, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in byte_pairs.decode(coded, ranks).collect()), key=repr)
    assert got == sorted(((d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows), key=repr)
    assert byte_pairs.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [(r.k, r.decoded) for r in byte_pairs.decode(nulls, ranks).orderBy("k").collect()] == [(1, None), (2, b"")]
    with pytest.raises(ValueError):
        byte_pairs.decode_ids(np.array([60_000]), byte_pairs.Vocabulary(ranks))


def test_op11_on_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op11_byte_bpe"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---------------------------------------------------------------- 12 vector codes


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) by loops over Python's numbers; rows are usable and of one length."""
    whole = sorted((i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows)
    spans = vector_codes.split_dims(len(whole[0][1]), parts)
    books = [[v[s] for _, v, _ in whole[:entries]] for s in spans]
    nearest = lambda p, cell: min((sum((a - b) ** 2 for a, b in zip(cell, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p, s in enumerate(spans):
            members = {}
            for _, v, _ in whole:
                members.setdefault(nearest(p, v[s])[1], []).append(v[s])
            books[p] = [[sum(c) // len(c) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = [(i, [nearest(p, v[s]) for p, s in enumerate(spans)], label) for i, v, label in whole]
    total = {}
    for _, near, label in found:
        total[label] = total.get(label, 0) + sum(e for e, _ in near)
    said = ",".join(str(x) for book in books for e in book for x in e)
    return sorted((i, "".join(f"{k:02x}" for _, k in near), sum(e for e, _ in near), total[label], hashlib.sha256(said.encode()).hexdigest()) for i, near, label in found)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims,parts,entries,n", [(8, 4, 5, 60), (7, 3, 4, 40), (3, 4, 2, 10), (16, 16, 64, 20)])
def test_codes_against_loops(spark, dims, parts, entries, n):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, dims).round(1)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows[1] = (rows[1][0], rows[0][1], rows[1][2])  # ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = vector_codes.compress(df, parts, entries)
    assert sorted(tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == plain_codes(rows, parts, entries, 2)


def test_vectors_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 7, -i / 3, 0.5, 1.0], 1) for i in range(9)]
    odd = [(20, None, 1), (21, [1.0, None, 1.0, 1.0], 1), (22, [nan] * 4, 1), (23, [1.0, -inf, 0.0, 0.0], 1), (24, [], 1), (25, [1.0], 1), (-5, [nan], 2)]
    df = spark.createDataFrame(good + odd, SCHEMA).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1))
    got = vector_codes.compress(df, 2, 4).collect()
    assert sorted(r.vec_id for r in got) == list(range(9)) and len({r.codebooks_sha256 for r in got}) == 1
    assert vector_codes.compress(df.filter("vec_id > 19"), 2, 4).count() == 1  # the empty vector is usable and the first by vec_id
    empty = vector_codes.compress(df.limit(0), 2, 4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_repeated_null_and_huge_vectors(spark):
    rows = [(1, [3.0e38, 1.0], None), (1, [3.0e38, 1.0], None), (None, [0.0, 0.0], 4), (None, [0.0, 0.0], 4), (2, [-3.0e38, 2.0], 4)]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), 2, 64).collect()
    assert len(got) == 5 and all(r.error == 0 for r in got)
    assert len({r.code for r in got if r.vec_id == 1}) == 1 and len({r.code for r in got if r.vec_id is None}) == 1


def test_codes_decode_to_the_nearest_entry(spark):
    df = spark.createDataFrame([(i, [float(i % 4), float(i % 3)], 0) for i in range(12)], SCHEMA)
    books = vector_codes.fit(df, 2, 12)
    back = vector_codes.decode(vector_codes.encode(df, books, ["vec_id", "embedding"]), books).collect()
    assert all(list(r.embedding) == list(r.decoded) and r.error == 0 for r in back)


# ---------------------------------------------------------------- 13 periodic runs


def brute_runs(x, least=24, times=3):
    """Every period by itself; a stretch belongs to its smallest one."""
    found, seen = [], set()
    for q in range(1, len(x) // times + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 120))]
        if len(x) > 5 and rng.random() < 0.7:
            p, s = rng.randint(1, max(1, len(x) // 4)), rng.randrange(len(x))
            for i in range(s + p, min(len(x), s + p * rng.randint(3, 9))):
                x[i] = x[i - p]
        yield x


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (2, 2), (6, 3)])
def test_runs_against_brute_force(least, times):
    some = 0
    for x in sequences(least, 1000):
        want = brute_runs(x, least, times)
        some += len(want)
        assert periodic_runs.runs_of(x, least, times) == want
        words = [b"w%d" % k for k in x]
        hashes = np.array([zlib.crc32(w) for w in words], np.uint64)
        assert periodic_runs.find(words, hashes, least, times) == want
    assert some > 200


def test_collisions_are_noticed(monkeypatch):
    x = [0, 1, 2] * 20 + [5] + [0, 1, 2] * 9
    want = brute_runs(x)
    assert len(want) == 2 and periodic_runs.runs_of(x) == want
    monkeypatch.setattr(periodic_runs, "BASES", (0, 1, periodic_runs.BASES[0]))  # bases that take many words for equal
    assert periodic_runs.runs_of(x) == want


def test_runs_of_odd_rows(spark):
    rows = [(1, " a\tb\n" * 12), (None, "x " * 24), (None, "x " * 23), (2, None), (3, ""), (4, "p q r " * 8 + "p q tail"), (4, "p q r " * 8 + "p q tail"), (5, "é\u00a0 " * 30), (6, "same " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = [
        (1, 24, [(0, 24, 2)], "a b"), (None, 24, [(0, 24, 1)], "x"), (None, 23, [], " ".join("x" * 23)), (2, 0, [], ""), (3, 0, [], ""),
        (4, 27, [(0, 26, 3)], "p q r tail"), (4, 27, [(0, 26, 3)], "p q r tail"), (5, 30, [(0, 30, 1)], "é\u00a0"), (6, 100_000, [(0, 100_000, 1)], "same"),
    ]
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_repeating_documents(spark):
    rows = [(d, " ".join(f"w{k}" for k in range(d % 40))) for d in range(200)] + [(None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", periodic_runs.repeating(F.col("text"), F.col("doc_id")).alias("made")).collect()
    changed = 0
    for r in got:
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        words = (r.text or "").split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.made == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            changed += r.made != r.text
        else:
            assert (r.made or "") == (r.text or "")
    assert changed > 3


# ---------------------------------------------------------------- 7 recall of re-parameterised items

FORMS = (
    "When {n} gave {n} {d} apples and {n} {d} pears on {n} {d} how many has {n} left",
    "A train leaves {n} at {d} km and reaches {n} after {d} hours while {n} drives {d} km to {n}",
    "Let {n} have {d} coins {n} {d} coins and {n} {d} coins then {n} sells {d} to {n}",
    "Code {d} {d} {d} {n} {n} {d} {d} {n} {d} {n} {n} {d} closes the ledger of {n}",
)
PEOPLE = "Mara Jonas Peter Lena Oskar Ines Tomas Rita Zorvan Kelmire Tashko Bryndal Ovelle Quistan Hamdor Ylvane".split()


def test_items_full_of_slots_are_found(spark):
    rng = random.Random(8)
    items, docs = [], []
    for k in range(80):
        names, numbers = rng.sample(PEOPLE, 8), rng.sample(range(2, 9999), 8)
        other, changed = rng.sample(PEOPLE, 8), rng.sample(range(2, 9999), 8)
        marks = [rng.randrange(8) for _ in range(20)]
        made = []
        for who, what in ((names, numbers), (other, changed)):
            slots = iter(marks)
            made.append(regex.sub(r"\{(.)\}", lambda m, who=who, what=what, slots=slots: str((who if m[1] == "n" else what)[next(slots)]), FORMS[k % 4]))
        filler = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
        items.append((k, made[0]))
        docs.append((k, f"{filler}\n{made[1]}\n{filler}"))
        docs.append((1000 + k, f"{filler}\n{filler} {rng.randrange(99)} {rng.choice(PEOPLE)} {rng.randrange(99)}"))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["__d"], r.item_id) for r in found.collect()}
    assert sum((k, k) in got for k in range(80)) >= 0.9 * 80 and not any(d >= 1000 for d, _ in got)
