"""State that streams keep between batches, against the batch operators over the same lines; and the template tree."""

import json
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlake.operators import mining, normalize, rows, template_tree
from eventlake.operators.mapping import Source
from eventlake.streaming import headers, templates

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TSV = Source("tsv", [("regex", "^[^#]")], "tsv", {"fields": ["a", "b"]}, otherwise="network_activity", classes={"network_activity": {"user.name": "who", "src_endpoint.ip": "ip"}})


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, path, batches, schema):
    """A stream whose batches are the given lists of rows."""
    path.mkdir()
    names = [c.split()[0] for c in schema.split(", ")]
    for k, batch in enumerate(batches):
        f = path / f"{k:03}.json"
        f.write_text("\n".join(json.dumps(dict(zip(names, row, strict=True))) for row in batch))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drained(frame, path):
    """All rows that a stream gives, with the batch that gave them."""
    out = str(path / "rows")

    def run(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    frame.writeStream.foreachBatch(run).option("checkpointLocation", str(path / "check")).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.parquet(out)


# ---------------------------------------------------------------- headers

LINES = "source string, n long, line string"
BATCHES = [
    [("s", 1, "#separator \\x2c"), ("s", 2, "#fields,who,ip"), ("s", 3, "ann,10.0.0.1"), ("t", 1, "x\ty"), (None, 1, "#fields\tq")],
    [("s", 4, "bob,none"), ("s", 5, "#unset_field,none"), ("s", 6, "eve,none"), ("t", 2, "#fields\tip\twho"), (None, 2, "v\tw")],
    [("t", 3, "10.0.0.2\tjoe"), ("s", 8, "kim,10.0.0.3,more"), ("s", 7, "#close,now"), ("s", 9, None), ("t", 4, "#separator \\xZZ"), ("t", 5, "#empty_field\t(nil)"), ("t", 6, "(nil)\tann")],
]
WANT = {
    ("s", 3): (["who", "ip"], "-", "(empty)", ","), ("t", 1): (None, "-", "(empty)", "\t"), ("s", 4): (["who", "ip"], "-", "(empty)", ","), ("s", 6): (["who", "ip"], "none", "(empty)", ","), (None, 2): (["q"], "-", "(empty)", "\t"),
    ("t", 3): (["ip", "who"], "-", "(empty)", "\t"), ("s", 8): (["who", "ip"], "none", "(empty)", ","), ("s", 9): (["who", "ip"], "none", "(empty)", ","), ("t", 6): (["ip", "who"], "-", "(nil)", "\t"),
}


def headers_of(found):
    return {(r.source, r.n): (list(r.header.fields) if r.header.fields is not None else None, *r.header[1:]) for r in found if not r.control}


def test_header_of_a_table(spark):
    df = spark.createDataFrame([r for b in BATCHES for r in b], LINES)
    got = headers.with_header(df, "source", "n").collect()
    assert len(got) == sum(map(len, BATCHES)) and headers_of(got) == WANT
    assert headers.with_header(df.limit(0), "source", "n").count() == 0


def test_header_of_an_earlier_batch(rocks, tmp_path):
    stream = stream_of(rocks, tmp_path / "in", BATCHES, LINES)
    found = drained(headers.stream_with_header(stream, "source", "n"), tmp_path)
    got = found.collect()
    assert len(got) == sum(map(len, BATCHES)) and headers_of(got) == WANT and {r.batch for r in got} == {0, 1, 2}
    # Control lines become unparsed events; the others are mapped by the names that their header gives.
    raw = normalize.envelope(found.withColumn("key", F.concat_ws("-", F.coalesce("source", F.lit("?")), "n")).withColumn("ms", F.col("n")), "line", "key", "ms", ("header", "control"))
    gold = {r.raw_ref: r for r in normalize.normalize(raw, [TSV]).collect()}
    assert len(gold) == len(got)
    shown = {k: (r.src_ip, r.user_name) for k, r in gold.items() if r.status != "unparsed"}
    assert shown["raw/s-3"] == ("10.0.0.1", "ann") and shown["raw/s-6"] == (None, "eve") and shown["raw/t-3"] == ("10.0.0.2", "joe") and shown["raw/t-6"] == (None, "ann") and shown["raw/t-1"] == (None, None)
    assert all(json.loads(gold[f"raw/{k}"].event)["reason"] == "control_line" for k in ("s-1", "s-2", "s-5", "s-7", "t-2", "t-4", "?-1"))


def test_oldest_source_is_forgotten(rocks, tmp_path):
    batches = [[(f"s{k}", 0, f"#fields\tf{k}") for k in range(3)], [("s2", 1, "#fields\tagain"), ("s9", 0, "#fields\tnew")], [(f"s{k}", 5, "x\ty") for k in (0, 1, 2, 9)]]
    found = drained(headers.stream_with_header(stream_of(rocks, tmp_path / "in", batches, LINES), "source", "n", most=3, buckets=1), tmp_path)
    assert {r.source: r.header.fields for r in found.filter("n = 5").collect()} == {"s0": None, "s1": ["f1"], "s2": ["again"], "s9": ["new"]}


def test_values_are_carried_over_ranges(spark):
    rng = np.random.default_rng(4)
    made = [(int(rng.choice([1, 1, 1, 2, 3])), i, int(i) if rng.random() < 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(made, "g int, i int, v int").repartition(3)
    last, want = {}, {}
    for g, i, v in made:
        last[g] = v if v is not None else last.get(g)
        want[i] = last[g]
    assert {r.i: r.c for r in rows.carried(df, ["g"], ["i"], {"c": F.col("v")}).collect()} == want


# ---------------------------------------------------------------- templates of a stream


def test_stream_counts_what_a_batch_counts(rocks, tmp_path):
    rng = np.random.default_rng(7)
    kinds = [f"{w} {v}" for w in ("user", "disk", "link", "job") for v in ("up", "down", "lost", "full")]
    lines = [(f"{i:04}", f"{kinds[int(rng.integers(0, 16))]} at {i} from 10.0.0.{i % 9}", f"p{i % 7}") for i in range(600)] + [("0601", None, "p1"), ("0602", "plain", None)]
    batches = [lines[i : i + 120] for i in range(0, len(lines), 120)]
    schema = "key string, line string, peer string"
    for most in (500, 2):  # room for all, and so little that every batch forgets templates
        here = tmp_path / str(most)
        here.mkdir()
        changes = templates.template_changes(stream_of(rocks, here / "in", batches, schema), "line", "key", "peer", most=most, buckets=2)
        templates.write_changes(changes, str(here / "out"), once=True).awaitTermination()
        stored = rocks.read.parquet(str(here / "out" / "changes"))
        got = {r.template_id: (r.template, r.n, round(r.share, 9), r.first_key, r.last_key, [x.line for x in r.samples]) for r in templates.clusters(stored).collect()}
        plain = mining.templates(rocks.createDataFrame(lines, schema), "line", "key")
        assert got == {r.template_id: (r.template, r.n, round(r.share, 9), r.first_key, r.last_key, list(r.samples)) for r in plain.collect()}
        assert stored.filter("fresh").count() == (len(got) if most == 500 else stored.filter("fresh").count())
        if most == 2:
            assert stored.filter("fresh").count() > len(got)
        peers = {r.template: list(r.peers) for r in templates.clusters(stored).collect()}
        want = defaultdict(set)
        for _, line, peer in lines:
            if line is not None:
                want[" ".join("<IP>" if "." in w else "<NUM>" if w.isdigit() else w for w in line.split())].update([peer] if peer else [])
        assert peers == {t: sorted(p)[:5] for t, p in want.items()}


# ---------------------------------------------------------------- the template tree


def plain_fold(members, similarity=0.5):
    known = []
    for w, n, parts in sorted(members, key=lambda m: (-m[1], " ".join(m[0]))):
        best = max(known, key=lambda k: sum(a == b or a == "<*>" for a, b in zip(k[0], w)), default=None)
        if best is None or sum(a == b or a == "<*>" for a, b in zip(best[0], w)) < similarity * len(w):
            known.append([w, n, parts])
        else:
            best[:] = [[a if a == b else "<*>" for a, b in zip(best[0], w)], best[1] + n, best[2] + parts]
    return known


def plain_tree(counts, depth=2):
    clusters = [(t.split() or [""], n, 1) for t, n in counts.items()]
    for level in range(depth, -1, -1):
        nodes = defaultdict(list)
        for c in clusters:
            nodes[len(c[0]), *["" if "<" in w else w for w in (*c[0], "", "")[:level]]].append(c)
        clusters = [tuple(c) for members in nodes.values() for c in plain_fold(members)]
    return Counter((" ".join(w), n, parts) for w, n, parts in clusters)


def some_templates(seed, n=300):
    rng = np.random.default_rng(seed)
    words = [["user", "host", "<NUM>"], ["ann", "bob", "eve", "<IP>"], ["opens", "closes", "<*>"], ["a", "b", "c"], ["x", "y"]]
    made = Counter(" ".join(str(rng.choice(w)) for w in words[: int(rng.integers(1, 6))]) for _ in range(n))
    made["odd one out here now"] = 1000  # the commonest, and like nothing else
    made[""] = 2
    return made


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_a_plain_one(spark, seed):
    made = some_templates(seed)
    df = spark.createDataFrame(list(made.items()), "template string, n long")
    got = Counter((r.template, r.n, r.parts) for r in mining.merged_templates(df).collect())
    assert got == plain_tree(made) and any("<*>" in t and p > 3 for t, _, p in got)
    assert sum(n for _, n, _ in got.elements()) == sum(made.values())


def test_tree_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 5), ("a  b\tc", 1), ("a b c", 2), ("   ", 1)], "template string, n long")
    assert {(r.template, r.n, r.parts) for r in mining.merged_templates(df).collect()} == {("a b c", 3, 1), ("", 1, 1)}
    assert mining.merged_templates(df.limit(0)).count() == 0


def test_full_nodes_are_dealt_and_lose_nothing(spark):
    hot = {f"login of u{i} failed": 1 + i % 3 for i in range(400)}  # one node, all alike
    far = {f"{i} {i} {i}": 1 for i in range(120)}  # one number of words, none like another
    df = spark.createDataFrame([*hot.items(), *far.items()], "template string, n long")
    want = {("login of <*> failed", sum(hot.values()), 400)} | {(t, 1, 1) for t in far}
    for parts in (1, 5):  # whatever the partitions
        assert {(r.template, r.n, r.parts) for r in template_tree.merge(df.repartition(parts), most=16).collect()} == want


@pytest.mark.parametrize("most", [5, 12])
def test_full_nodes_are_folded_as_one(spark, most):
    made = some_templates(7, 120)
    sizes = Counter(len(t.split() or [""]) for t in made).values()
    assert min(sizes) <= most < max(sizes)
    df = spark.createDataFrame(list(made.items()), "template string, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small nodes lie in several partitions, as in large tables
    try:
        got = Counter((r.template, r.n, r.parts) for r in template_tree.merge(df, most=most, depth=0).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_tree(made, 0)


def test_turns_of_a_node_go_on_with_its_clusters():
    rng = np.random.default_rng(5)
    made = sorted({tuple(str(rng.choice(list("abcd"[: k % 3 + 2]))) for k in range(6)) for _ in range(300)})
    members = [(list(w), int(rng.integers(1, 4)), 1) for w in made]
    members.sort(key=lambda m: (-m[1], " ".join(m[0])))
    rows, states, gained = [(*m, age) for age, m in enumerate(members)], [], Counter()
    for at in range(0, len(rows), 10):
        some, found = rows[at : at + 10], {}
        for seen, known in enumerate(states):  # every state that a turn has left, as on a cluster
            scores, firsts = template_tree.agreed(pa.array([" ".join(w) for w, *_ in known]), pa.array([" ".join(w) for w, *_ in some]))
            for (*_, age), score, first in zip(some, scores.tolist(), firsts.tolist()):
                words, *_, older = known[first]
                if score >= 3 and (score, -older, seen) > found.get(age, (0,))[0:1] + found.get(age, (0, 0, 0))[1:3]:
                    found[age] = (score, -older, seen, words)
        states.append(sorted(template_tree.fold(some, 0.5, {age: (f[0], -f[1], f[3]) for age, f in found.items()}), key=lambda c: c[3]))
    last = {}
    for known in states:
        for words, n, parts, age in known:
            last[age] = words
            gained[age, "n"] += n
            gained[age, "parts"] += parts
    got = Counter((" ".join(w), gained[age, "n"], gained[age, "parts"]) for age, w in last.items())
    assert got == Counter((" ".join(w), n, parts) for w, n, parts in plain_fold(members)) and any("<*>" in t for t, *_ in got)


def test_turns_join_nothing_but_names(spark, monkeypatch):
    far = spark.createDataFrame([(f"{i} {i} {i}", 1) for i in range(60)], "template string, n long")
    join, sizes = type(far).join, []
    monkeypatch.setattr(type(far), "join", lambda self, other, *a: sizes.append(other.count()) or join(self, other, *a))
    got = template_tree.merge(far, most=2, depth=0).collect()
    assert {(r.template, r.n, r.parts) for r in got} == {(f"{i} {i} {i}", 1, 1) for i in range(60)}
    assert sizes and max(sizes) <= 8  # two a range at most; clusters of 29 turns, against as many copies of members, before


def test_turns_double_while_their_words_fit(spark):
    rows = [(age, 5, words) for words in (3, 200_000) for age in range(200)]
    got = spark.createDataFrame(rows, "age long, fits int, len int").groupBy("len", template_tree._turn().alias("turn")).agg(F.count("*").alias("k"), F.min("age").alias("at")).orderBy("len", "turn").collect()
    assert [(r.turn, r.k, r.at) for r in got if r.len == 3] == [(0, 5, 0), (1, 10, 5), (2, 20, 15), (3, 40, 35), (4, 40, 75), (5, 40, 115), (6, 40, 155), (7, 5, 195)]
    assert [(r.turn, r.k, r.at) for r in got if r.len == 200_000] == [(k, 5, 5 * k) for k in range(40)]


def test_ranges_of_long_templates_keep_the_order(spark):
    long = [("x" * 300 + f"{i:03}", 1) for i in range(100)] + [(f"{i:03}", 1) for i in range(100)]
    df = spark.createDataFrame(long, "template string, n long")
    placed = rows.running(df, ["n"], [F.col("template")], near=[F.left("template", F.lit(256))]).collect()
    assert {r.template: r["__before"] for r in placed} == {t: k for k, t in enumerate(sorted(t for t, _ in long))}


def test_every_bucket_meets_every_other_once(spark):
    for k in range(1, 9):
        turns = max(1, k + k % 2 - 1)
        df = spark.range(k).crossJoin(spark.range(turns).withColumnRenamed("id", "turn"))
        met = Counter()
        for turn in range(turns):
            pairs = defaultdict(list)
            for r in df.filter(F.col("turn") == turn).select("id", template_tree._met(F.col("id"), F.lit(k), turn).alias("pair")).collect():
                pairs[r.pair].append(r.id)
            met.update(tuple(sorted(p)) for p in pairs.values() if len(p) > 1)
            assert all(len(p) <= 2 for p in pairs.values())
        assert met == Counter((a, b) for a in range(k) for b in range(a + 1, k))
