"""Atoms and shapes of lines, against a plain version over the same lines."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from eventlake.operators import structure

ORDERED = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in structure.KINDS))
LINES = [
    *[f"fw forward: in:ether{i % 3} out:bridge, src-mac aa:bb:cc:00:11:{i:02x}, proto {('TCP', 'UDP', 'ICMP')[i % 3]}, 10.0.0.{i}:80->192.0.2.1:{i}, len {i}" for i in range(40)],
    *[f"fw forward: in:ether1 out:bridge, src-mac aa:bb:cc:00:11:{i:02x}, proto TCP, 10.0.0.{i}:80->192.0.2.1:{i}, NAT 10.0.0.1:7, len {i}" for i in range(3)],
    "2024-05-06 07:08:09.5+0200 x 0xFF -3.5 (unknown 0) é\u00a0z => b <- c 12:30:01", "Jan  2 2024 01:02:03 host", "Jan 12 01:02:03 host 123e4567-e89b-12d3-a456-426614174000", "", "a\nb", "fw fw :fw", "word " * 2000,
]


def cut(line):
    return [(m.lastgroup, m.group()) for m in ORDERED.finditer(line)]


def plain(lines, share=0.9):
    cuts = [cut(x) for x in lines]
    seen = Counter(w for c in cuts for w in {t for k, t in c if k == "WORD"})
    valued = {b[1] for c in cuts for a, b in zip(c, c[1:]) if b[0] == "WORD" and a[1] in structure.BEFORE_VALUE}
    clause = set()
    for c in cuts:
        solid = [x for x in c if x[0] != "SP"]
        clause |= {b[1] for a, b, d in zip(solid, solid[1:], solid[2:]) if b[0] == "WORD" and a == ("PUNCT", ",") and d[0] in structure.CLAUSE_VALUE}
    steady = {w for w, n in seen.items() if n >= share * len(lines)} - valued
    by_shape = defaultdict(list)
    for c in cuts:
        by_shape[tuple((k, t if k in structure.FIXED or (k == "WORD" and t in steady) else None) for k, t in c)].append(c)
    out = Counter()
    for shape, members in by_shape.items():
        parts = []
        for i, (kind, text) in enumerate(shape):
            here = {m[i][1] for m in members}
            word = next(iter(here))
            if text is None and kind == "WORD" and len(here) == 1 and word in clause and word not in valued and seen[word] >= 2 and word.isalpha():
                text = word
            parts.append(f"<{kind}>" if text is None else text)
        out["".join(parts)] += len(members)
    return out


def test_atoms_are_the_line(spark):
    df = spark.createDataFrame([(x,) for x in LINES] + [(None,)], "line string")
    for r in df.select("line", structure.atoms(F.col("line")).alias("a")).collect():
        if r.line is None:
            assert r.a is None
            continue
        assert [(x.kind, x.text) for x in r.a] == cut(r.line)
        assert "".join(x.text for x in r.a) == r.line


def test_shapes_agree_with_a_plain_version(spark):
    for lines in (LINES, LINES[:43]):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(-1, None)], "id long, line string").repartition(5)
        got = structure.groups(df, "line", "id").collect()
        assert Counter({r.skeleton: r.n for r in got}) == plain(lines)
        assert abs(sum(r.share for r in got) - 1) < 1e-9 and min(r.first_key for r in got) == 0
    # Of the two shapes, one has the clause as structure; interfaces and protocols are variables.
    shown = sorted((r.n, r.skeleton) for r in got)
    assert [n for n, _ in shown] == [3, 40] and ", NAT <IP>:<NUM>" in shown[0][1] and "in:<WORD>" in shown[1][1] and "proto <WORD>," in shown[1][1]
    assert structure.groups(df.limit(0), "line", "id").count() == 0
