"""The registered queries on the smallest tables: against their SQL, or against plain versions where there is none."""

import hashlib
import os
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from eventlake.llm import queries
from eventlake.llm.sql import OP3

from ..oracle import database, same
from .test_small import SPACE, brute_components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    same(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLE_SQL[name])


def test_op1(spark, texts):
    got = queries.QUERIES["op1_media_columns"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_op2(spark, con):
    import html
    import re

    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    got = queries.QUERIES["op2_main_text"](spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op5(spark, con, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality"](spark, FOLDER).collect()}
    assert sorted(got) == sorted(texts)
    labels = [x for x in con.execute("SELECT doc_id, quality FROM labels").fetchall() if x[0] in got and got[x[0]].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert sum(got[i].predicted == q for i, q in labels) >= 0.9 * len(labels)


def test_op7(spark, con, texts):
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    plain = lambda t: f" {' '.join(SPACE.findall(t.lower()))} "
    items = {i: plain(t) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()}
    assert got == {(d, i) for d, t in texts.items() for i, x in items.items() if x in plain(t)}


def test_op9(spark, texts):
    got = queries.QUERIES["op9_sharding"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in got)


def test_op10(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op10_near_dedup"](spark, FOLDER).collect()}
    assert got == brute_components(list(texts.items()), 2, 80)


def test_pipeline(spark, con, texts, tmp_path):
    """Each stage against a plain version on what the stage before it wrote."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, texts
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
        assert all(texts[r.doc_id] == (r.text or "") for r in rows)
        ids = sorted(r.doc_id for r in rows)
        if k == 0:
            labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
            wrong = [i for i, q in labels.items() if i in before and (i in set(ids)) != (q == 1)]
            assert len(wrong) <= 0.03 * len(labels)
        elif k == 1:
            assert ids == sorted(i for i, (_, c) in brute_components(list(before.items()), 5, 80).items() if i == c)
        elif k == 2:
            plain = lambda t: f" {' '.join(SPACE.findall(t.lower()))} "
            items = [plain(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
            assert ids == sorted(i for i, t in before.items() if not any(x in plain(t) for x in items))
        elif k == 3:
            mine = database(FOLDER)
            mine.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
            counts = defaultdict(int)
            for r in rows:
                counts[r.doc_id] += 1
            taken = {i: t // s for i, s, t in mine.execute(f"SELECT doc_id, size, taken FROM ({OP3}) WHERE size > 0").fetchall()}
            assert {i: n for i, n in taken.items() if n} == dict(counts)
        else:
            size = defaultdict(int)
            for r in rows:
                size[r.shard] += len((r.text or "").encode()) + 16
            largest = max(len(t.encode()) for t in before.values()) + 16
            assert ids == last and max(size.values()) <= sum(size.values()) / 40 + 3 * largest
        before, last = {i: texts[i] for i in ids}, ids
    assert corpus_pipeline.run(spark, FOLDER).count() == len(ids)
