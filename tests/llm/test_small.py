"""The training-data operators on small tables: nulls, empty and long texts, repeats, ties, clashing columns."""

import hashlib
import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.llm import chat, common, decontamination, extraction, line_dedup, media, mixing, near_dedup, quality, sharding, substring_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __d string, size string"


def words(n, salt=""):
    return " ".join(f"w{salt}{i}" for i in range(n))


def docs(spark, rows):
    """(doc_id, text[, source]) as documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y") for r in rows], DOCS)


ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "a"), (4, "a"), (4, "a"), (None, "null id " * 3), (None, "other"), (5, "é ü 漢字 😀"), (6, words(30_000))]


# ---------------------------------------------------------------- words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8"))), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = common.Words(pa.array(texts, pa.string()))
    found = [[bytes(got.data[got.start[k] : got.end[k]]).decode() for k in range(got.first[i], got.first[i + 1])] for i in range(len(texts))]
    assert found == [SPACE.findall(t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    a = common.Words(pa.array(["x yy zz", "zz x", "yy"])).hashes()
    assert a[0] == a[4] and a[1] == a[5] and a[2] == a[3] and len(set(a.tolist())) == 3
    v = np.arange(20, dtype=np.uint64) * np.uint64(7)
    w = common.window_hashes(v, 5)
    assert len(w) == 16 and w[3] == common.window_hashes(v[3:8], 5)[0]
    assert common.range_hashes(v, np.array([2, 3]), np.array([7, 8]))[1] == common.range_hashes(v[3:], np.array([0]), np.array([5]))[0]


# ---------------------------------------------------------------- 1 media


def test_media_come_back(spark, tmp_path):
    docs(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op1(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in ODD:
        raw = (t or "").encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(data) + 44)
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in by[i]]
    assert by[3][0].feature == by[4][0].feature and by[0][0].media_sha256 == by[1][0].media_sha256
    assert all(r.position == 1 and r.caption == f"document {r.doc_id}" for r in got if r.doc_id is not None)


def test_features_of_samples():
    for data in (b"\x80" * 192, bytes(range(192)), bytes([0, 255] * 96)):
        x = [b - 128 for b in data]
        rms, mean = math.sqrt(sum(v * v for v in x) / len(x)), sum(x) / len(x)
        crossed = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert media.feature(data) == f"rms={rms:.4f};mean={mean:.4f};crossings={crossed};peak={max(map(abs, x))}"
        assert media.samples(media.wav(data)) == data


def test_captions_and_positions_of_pages(spark):
    """Sequences of whole pages: media of several figures keep their place and caption through the join."""
    html = "<article><p>before</p>" + "".join(f'<figure><img src="media:d{k % 3}" alt="a{k}"><figcaption>cap {k}</figcaption></figure><p>after {k}</p>' for k in range(6)) + "</article>"
    pages = spark.createDataFrame([(k, html) for k in range(20)], "k long, html string")
    stored = spark.createDataFrame([(f"d{k}", bytes([k])) for k in range(3)], "digest string, stored binary")
    got = media.resolve(media.exploded(media.interleave(pages, ["k"])), stored).collect()
    for k in range(20):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(13)) and [r.text for r in mine][::2] == ["before", *[f"after {i}" for i in range(6)]]
        assert [(r.caption, bytes(r.stored)) for r in mine[1::2]] == [(f"cap {i}", bytes([i % 3])) for i in range(6)]


def test_sequences_stay_in_order():
    parts = media.parse_parts('<p>one <b>two</b></p><figure><img src="media:d1" alt="x"><figcaption>cap</figcaption></figure>three<img src="d2" alt="alt"><script>no</script><p>four')
    assert [(p["kind"], p["text"] or p["digest"], p["caption"]) for p in parts] == [("text", "one two", None), ("image", "d1", "cap"), ("text", "three", None), ("image", "d2", "alt"), ("text", "four", None)]
    assert media.parse_parts(None) == []


def test_parts_without_medium_stay(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="d1"><img src="gone">'), (2, None)], "k long, html string")
    stored = spark.createDataFrame([("d1", b"x")], "digest string, stored binary")
    parts = media.exploded(media.interleave(pages, ["k"]))
    assert [(r.digest, bytes(r.stored)) for r in media.payloads_of(parts, stored).collect()] == [("d1", b"x")]
    got = media.resolve(parts, stored).orderBy("position").collect()
    assert [(r.k, r.position, r.kind, r.digest, r.stored) for r in got] == [(1, 0, "text", None, None), (1, 1, "image", "d1", bytearray(b"x")), (1, 2, "image", "gone", None)]


@given(st.binary(max_size=400).map(lambda b: b + b"\0" * (len(b) % 2)))
def test_wav_is_lossless(data):
    import io
    import wave

    assert media.samples(media.wav(data)) == data
    with wave.open(io.BytesIO(media.wav(data))) as w:
        assert w.getsampwidth() == 1 and w.readframes(len(data)) == data


# ---------------------------------------------------------------- 2 extraction

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div>
<article><h1>Title &amp;  more</h1><p>First&nbsp;para<br>goes on. <i>All</i> of it.<p>Second &lt;b&gt; &eacute;<aside>Aside</aside><div class="ad">Buy</div><form>Name <input></form>
<ul><li>one<li>two</ul></article><section class="comments"><p>Great!</p></section><footer>&copy; us</footer></body></html>"""


def test_article_alone():
    assert main_of(PAGE) == "Title & more\nFirst para goes on. All of it.\nSecond <b> é\none\ntwo"


def test_pages_without_article_element():
    page = '<body><div class="menu"><a href="/">Home</a></div><div class="wrap"><h1>Head</h1><div class="post-body"><p>Long text here and more of it.</p><p>Second.</p></div></div><div><a href="x">Link link link</a></div></body>'
    assert main_of(page) == "Head\nLong text here and more of it.\nSecond."


def test_template_text_of_a_host_is_dropped(spark):
    body = lambda i: f"<html><body><article><h1>Story {i}</h1><p>Only here {i} and there {i * 7}.</p><p>Read all our stories every day.</p></article></body></html>"
    rows = [(i, f"https://a.example/{i}", body(i)) for i in range(6)] + [(10, "https://b.example/1", body(1)), (11, None, None), (12, "", ""), (12, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    for most in (1000, -1):  # broadcast, and joined by shuffle
        got = extraction.main_text(pages, broadcast_most=most).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == 10 and by[3] == "Story 3\nOnly here 3 and there 21."
        assert by[10].endswith("Read all our stories every day.") and by[11] == "" and by[12] == ""
        assert all(r.n_chars == len(r.text) for r in got)


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><p>The same article on every page.</p><p>And its second paragraph.</p></article>"
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>{page}") for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in extraction.main_text(pages).collect()} == {"The same article on every page.\nAnd its second paragraph."}


def hosted(spark, pages, **options):
    rows = spark.createDataFrame([(i, f"https://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in extraction.main_text(rows, **options).collect()}


def test_the_template_decides_without_article_elements(spark):
    """The article lies in a plain element that no word list knows, beside longer texts that all pages share."""
    teaser = "<p>All our readers find here what they want to know about the town, its people and what goes on there, every day of the year.</p>" * 3

    line = lambda w, own: f"{w} {own}a {own}b {own}c tells {own}d, {own}e and {own}f."

    def page(i, own):
        told = "".join(f"<p>{line(w, own)}</p>" for w in ("One", "Two"))
        return f'<body><div class="x1"><b>Daily</b>{teaser}</div><div class="x2">{told}<p>Shared by {i} readers on the town page today</p></div><div class="x3"><p>Made in town since 1990</p></div></body>'

    pages = [page(i, f"v{i * i}") for i in range(8)]
    got = hosted(spark, pages)
    for i, r in got.items():
        assert r.text == "\n".join(line(w, f"v{i * i}") for w in ("One", "Two"))
        assert r.n_template == len(f"Shared by {i} readers on the town page today")
    alone = hosted(spark, pages, least_pages=100)  # no template: the largest element, whatever it says
    assert all(r.text != got[i].text and r.n_template == 0 for i, r in alone.items())


def test_long_and_deep_markup_is_read_in_linear_time():
    import time

    for page in ("<a " * 200_000, "<div>" * 100_000, "<div><p>x" * 50_000, "<li>" * 50_000 + "</ul>" * 50_000, '<a href="' * 50_000, "<div " + "a" * 300_000 + ">x", "<!--" * 100_000, "<script>" * 50_000, "<article>x" * 20_000, "</p>" * 100_000, "<" * 300_000, "&" * 300_000):
        began = time.perf_counter()
        main_of(page)
        assert time.perf_counter() - began < 5, page[:20]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='<>/ap"=&; \n!-', max_size=60))
def test_any_markup_is_read(page):
    main_of(page)


def main_of(page):
    return extraction.article(*extraction.parse(page))[0]


@pytest.mark.parametrize("layout", ["content has-sidebar", "no-sidebar", "page header-fixed", "with-banner"])
def test_wrappers_of_the_article_stay(layout):
    page = f'<body><div class="{layout}"><article><h1>Head</h1><p>Text of it.</p></article><div class="sidebar"><p>Side</p></div></div></body>'
    assert main_of(page) == "Head\nText of it."
    assert main_of(f'<body class="{layout}"><form><main><h1>Title</h1><div class="{layout}"><article><p>A text much longer than the title.</p></article></div></main></form></body>').endswith("A text much longer than the title.")
    assert main_of(f'<body><div class="{layout}"><p>A page without article, all in one.</p></div><div class="ad"><p>Buy</p></div></body>') == "A page without article, all in one."


def test_headings_and_sections_of_an_article_stay():
    page = '<article><h2 id="social-context">Context</h2><p>one</p><section id="discussion"><h3 id="share-of-market">Share</h3><p>two</p></section><section id="comments"><p>Great!</p></section></article>'
    assert main_of(page) == "Context\none\nShare\ntwo"


def test_comments_are_no_article():
    page = '<article><p>Short post.</p></article><section class="comments"><article><p>A comment that is very much longer than the post itself.</p></article></section>'
    assert main_of(page) == "Short post."
    assert main_of(f"<main>{page}</main>") == "Short post."


def test_all_parts_of_an_article_stay():
    assert main_of('<main><article>part 1, the longer one</article><article>part 2</article><article class="related">other</article></main>') == "part 1, the longer one\npart 2"
    assert main_of("<body><article>part 1, the longer one</article><article>part 2</article></body>") == "part 1, the longer one\npart 2"
    assert main_of('<body><h1>Head</h1><section><p>one one</p></section><section class="b"><p>two</p></section><footer>f</footer></body>') == "Head\none one\ntwo"
    assert main_of("<main><p>The text itself is in no article element.</p><article>teaser</article></main>").startswith("The text itself")


def test_less_than_signs_are_text():
    assert main_of("<article><p>If a < b and 1 <2 then so") == "If a < b and 1 <2 then so"
    assert main_of('<article><p>cut <a href="x') == "cut"


# ---------------------------------------------------------------- 3 mixing


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(int(rng.integers(1, 60))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 3000, p=[0.02, 0.3, 0.3, 0.38]))]
    rows += [(5000 + k, t) for k, (_, t) in enumerate(ODD[:6])] + [(None, "x y z", None), (7000, words(40), None), (7001, "q", "")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {r[0]: r[2] if len(r) > 2 else "s" for r in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(SPACE.findall(next(x[1] for x in rows if x[0] == r.doc_id) or ""))
        by[source[r.doc_id]][0] += r.taken
        by[source[r.doc_id]][1:] = [r.source_size, r.target]
    total = sum(x[1] for x in by.values())
    assert math.isclose(sum(x[2] for x in by.values()), total)
    for taken, size, target in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 60
    order = sorted((s for s in by if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    share = {s: dict.fromkeys(by, 0.0)[s] for s in by}  # water filling, one source after another
    free, left = set(by), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * by[s][1]}
        for s in over or free:
            share[s] = 3.0 * by[s][1] if over else weight[s] * level
        left -= sum(share[s] for s in over)
        free = free - over if over else set()
    assert all(math.isclose(share[s], by[s][2]) for s in by)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    copies = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in copies} == {(r.doc_id, r.copies) for r in got if r.copies}
    assert mixing.mixed(df).columns == df.columns


def test_mix_by_weight_takes_heavy_rows_more_often(spark):
    rows = spark.createDataFrame([(i, words(10), "a" if i < 400 else "b", float(1 + 9 * (i % 2))) for i in range(500)], "doc_id long, text string, source string, w double")
    got = mixing.mix(rows, weight="w").filter("doc_id < 400").collect()
    heavy, light = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert heavy > 2 * light and abs(heavy + light - got[0].target) <= 10


def test_empty_tables(spark, tmp_path):
    none = docs(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mixing.mix(none).count() == line_dedup.drop_common_lines(none).count() == substring_dedup.drop_repeated_spans(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == sharding.shard_by_bytes(none).count() == sharding.sharded(none).count() == 0
    assert quality.judge(none, labels, ["doc_id"]).count() == decontamination.leaks(none, bench).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 4 lines


def test_common_lines(spark):
    line = "This line is found in many a document"
    rows = [(11, f"{line}\nown one"), (12, f"  {line.upper()}\t\nown two\n"), (13, f"{line}\n{line}"), (14, "short\nown"), (15, "short"), (16, "short"), *ODD]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs(spark, rows)).collect()}
    assert (got[11].kept_text, got[11].n_lines, got[11].n_dropped) == ("own one", 2, 1)
    assert (got[12].kept_text, got[12].n_lines, got[12].n_dropped) == ("own two\n", 3, 1)
    assert got[13].kept_text == f"{line}\n{line}" and got[13].n_dropped == got[14].n_dropped == 0
    assert got[0].kept_text == "" and got[0].n_lines == 1
    assert line_dedup.drop_common_lines(docs(spark, rows)).count() == len(rows)


def test_rows_of_one_id_lose_their_own_lines(spark):
    line = "This line is found in many a document"
    rows = [(11, line), (12, line), (13, line), (None, f"own a\nown b\n{line}"), (None, "a first line of its own\nb\na third line of its own"), (None, "short"), (9, f"{line}\nkept"), (9, "another text of that id\nkept too")]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_common_lines(docs(spark, rows)).collect())
    assert got[:5] == [(0, 1, 0, "short"), (0, 3, 0, rows[4][1]), (0, 3, 1, "own a\nown b"), (9, 2, 0, rows[7][1]), (9, 2, 1, "kept")]


# ---------------------------------------------------------------- 5 quality


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("etaoinshr"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(8, 80))))
    junk = [lambda t: t.upper(), lambda t: " ".join(w + "$$$" for w in t.split()), lambda t: t.replace(" ", " | "), lambda t: " ".join(w for w in t.split()[:10] for _ in range(6))]
    rows = [(i, junk[i % 4](text()) if i % 5 == 0 else text()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(600)] + [(0, None, 0), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, [*rows, *[(1000 + k, t) for k, (_, t) in enumerate(ODD)]])
    got = quality.judge(df, labels, ["doc_id"]).withColumn("held_out", quality.held_out()).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum((r.doc_id % 5 != 0) == (r.predicted == 1) for r in held) / len(held) >= 0.95
    good = quality.good(df, labels)
    assert good.columns == df.columns and {r.doc_id for r in good.select("doc_id").collect()} == {r.doc_id for r in got if r.predicted}


def test_labels_of_one_class(spark):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.judge(docs(spark, ODD), labels, ["doc_id"]).collect()} == {1}


def test_score_does_not_depend_on_the_batch():
    net = quality.train(["aaa bbb ccc " * 5, "$$$ %%% " * 9, "abc", "$$"], [1, 0, 1, 0], epochs=3, steps=3)
    texts = ["", "x", "aaa bbb " * 40, "é" * 33, "q" * 64, "q" * 65]
    alone = [net.forward(*common.buffers(pa.array([t])))["score"][0] for t in texts]
    assert np.allclose(alone, net.forward(*common.buffers(pa.array(texts)))["score"], atol=1e-5)


def test_gradient():
    net = quality.Network(1)
    net.weights[:] = np.linspace(-1, 1, len(net.weights))
    data = common.buffers(pa.array(["some text of more than one cell, thus with chunks that overlap", "abc", ""]))
    y = np.array([1, 0, 1], np.float32)
    passed = net.forward(*data)
    grads = net.gradients(passed, passed["score"] - y)
    loss = lambda: float(-(y * np.log(net.forward(*data)["score"]) + (1 - y) * np.log(1 - net.forward(*data)["score"])).sum())
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert math.isclose((up - down) / (2 * eps), float(g[at]), rel_tol=0.05, abs_tol=2e-3)


# ---------------------------------------------------------------- 6 spans


def brute_spans(rows, window):
    first = {}
    lists = [(-math.inf if i is None else i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in lists:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, math.inf), i)
    out = []
    for i, w in lists:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 12])
def test_spans_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    passage = words(70, "p")
    rows = [*ODD, *[(100 + i, f"{words(int(rng.integers(0, 90)), i)} {passage if i % 3 else words(49, 'p')} {words(20, i + 1)}") for i in range(25)], (200, passage + " " + passage), (201, words(30_000)), (202, " ".join(["z"] * 300)), (203, " ".join(["z"] * 120))]
    rows += [(300, rows[12][1]), (300, rows[12][1]), (301, words(55, "p") + " and " + words(30, 11))]
    got = substring_dedup.drop_repeated_spans(docs(spark, rows), window).collect()
    found = sorted((-math.inf if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got)
    assert found == brute_spans([(r[0], r[1]) for r in rows], window)
    by = {i: SPACE.findall(t or "") for i, t in rows if i is not None}
    assert any(len(r.factors) > 1 for r in got)
    for r in got:
        mine, upto = by.get(r.doc_id, []), 0
        for f in r.factors if r.doc_id is not None else ():
            assert f.reference < r.doc_id and mine[f.start : f.start + f.words] == by[f.reference][f.position : f.position + f.words]
            assert f.start >= upto and (f.words >= window or f.start == upto)  # shorter only at the boundary of another
            upto = f.start + f.words
        assert sum(f.words for f in r.factors) == r.n_removed


def test_factors_follow_one_reference():
    places, refs, at = np.arange(10), np.array([1] * 4 + [2] * 6), np.array([5, 6, 7, 8, 0, 1, 2, 9, 10, 11])
    got = [x.tolist() for x in substring_dedup.factors(places, refs, at, 5)]
    assert got == [[0, 8, 11], [8, 3, 3], [1, 2, 2], [5, 4, 13]]  # the second and third begin where the one before ends


# ---------------------------------------------------------------- 7 decontamination

ITEM = "Alice has 12 apples and gives 5 apples to Bob before lunch. How many apples does Alice keep after she walks 3 km home?"


def leaked(spark, texts, **more):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM)], "item_id long, text string")
    found = decontamination.leaks(docs(spark, list(enumerate(texts))), bench, **more).collect()
    return {r["__d"]: r.kind for r in found}


def test_leaks(spark):
    filler = words(60)
    texts = [
        f"{filler} {ITEM} {filler}", ITEM.upper(), f"{filler}\n{ITEM.replace('apples', 'pears', 1)}",
        f"{filler}. Well, Carol has 40 apples and gives 7 apples to Dave before lunch. How many apples does Carol keep after she walks 9 miles home?",
        filler, None, "", "1 2 3 4 5 6 7 8 9 10 " * 30, "How many apples does it take?",
        "Carol has 40 apples and gives 7 apples to Dave before lunch. How many apples does Erin keep after she walks 9 miles home? " * 1,
    ]
    for most in (decontamination.FILTER_MOST, 0):  # filtered by the items' hashes, and joined in full
        got = leaked(spark, texts, filter_most=most)
        assert {0, 1, 2, 3} <= set(got) and got[0] == "exact" and got[3] == "re-parameterised"
        assert not set(got) & {4, 5, 6, 7, 8}
    kept = decontamination.decontaminate(docs(spark, list(enumerate(texts))), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6, 7, 8} and kept.columns == docs(spark, []).columns


def test_capitals_do_not_hide_a_copy(spark):
    names = "Which Treaty did King Philip of Spain sign with Queen Mary of England in Madrid"
    plain = "which rivers of the far north are frozen for most of the year and why"
    bench = spark.createDataFrame([(1, names), (2, plain), (3, "Der Vertrag der Stadt mit dem Herzog über die Brücke am Tor")], "item_id long, text string")
    texts = [names, names.lower(), names.upper(), f"{words(9)} {names.lower()} {words(9)}", plain.title(), plain.upper(), "der vertrag der stadt mit dem herzog über die brücke am tor", words(20)]
    for most in (decontamination.FILTER_MOST, 0):
        found = decontamination.leaks(docs(spark, list(enumerate(texts))), bench, filter_most=most).collect()
        assert {(r["__d"], r.item_id, r.kind) for r in found} == {(i, 1, "exact") for i in range(4)} | {(4, 2, "exact"), (5, 2, "exact"), (6, 3, "exact")}


def test_every_row_of_the_benchmark_is_looked_for(spark):
    short, long = "the quick red fox jumps over one very lazy dog", words(100, "q")
    bench = spark.createDataFrame([(1, short), (1, long), (None, words(12, "n")), (None, words(12, "m")), (2, "Photosynthesis?"), (3, "Battle of Hastings"), (4, "?!"), (5, None)], "item_id long, text string")
    texts = [f"{words(9)} {short} {words(9)}", long, words(12, "n"), f"x {words(12, 'm')} y", "it is photosynthesis, photosynthesis", "the battle of Hastings.", "battle of", words(30), "", None]
    for most in (decontamination.FILTER_MOST, 0):
        found = decontamination.leaks(docs(spark, list(enumerate(texts))), bench, filter_most=most).collect()
        assert sorted((r["__d"], r.item_id or 0, r.coverage) for r in found) == [(0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0), (3, 0, 1.0), (4, 2, 1.0), (5, 3, 1.0)]
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, list(enumerate(texts))), bench).collect()} == {6, 7, 8, 9}


def test_repetitive_texts_cost_their_places(spark):
    item = "again " * 60
    texts = ["again " * 30_000, f"{words(40_000)} {item}", "again", None]
    rows = [*enumerate(texts), (None, item), (None, words(9))]
    found = decontamination.leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["__d"], r.coverage) for r in found) == [(common.NULL_ID, 1.0), (0, 1.0), (1, 1.0)]


def test_values_must_map_consistently():
    m = lambda p, t, u: {"found": [{"p": p, "t": t}], "asked": [{"q": p, "u": u}]}
    same = [m(0, ["\x01ann", "has", "\x015", "of", "\x015"], ["\x01bob", "has", "\x017", "of", "\x017"])]
    other = [m(0, ["\x01ann", "has", "\x015", "of", "\x016"], ["\x01bob", "has", "\x017", "of", "\x017"])]
    assert decontamination.align(same, 5, 5)[1] == 1.0 and decontamination.align(other, 5, 5)[1] < 0.8


# ---------------------------------------------------------------- 8 chat


@given(st.text(alphabet="<|\\>ab", max_size=30))
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_chats(spark):
    rows = [(1, 1, "assistant", "yes <|im_end|> <\\|x"), (1, 0, "user", None), (1, 1, "assistant", "again<"), (None, 0, None, "hi"), (2, None, "user", ""), (3, 0, "assistant", "q" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert chat.read_turns(got[1].formatted) == [("user", ""), ("assistant", "again<"), ("assistant", "yes <|im_end|> <\\|x")]
    assert [chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss_spans] == ["again<", "yes <|im_end|> <\\|x"]
    assert chat.read_turns(got[None].formatted) == [("", "hi")] and chat.read_turns(got[2].formatted) == [("user", "")] and len(got) == 4
    with pytest.raises(ValueError):
        chat.read_turns(got[1].formatted + "x")


def test_typed_parts(spark):
    content = '[{"type":"text","text":"see <|"},{"type":"image","reference":"i1","width":56,"height":30},{"type":"audio","reference":"a1","seconds":2},{"type":"document","reference":"d1","pages":3}]'
    row = chat.format_chats(spark.createDataFrame([(1, 0, "user", content)], "conv_id long, turn long, role string, parts string"), "parts", typed=True).first()
    assert [(a.kind, a.reference, a.tokens) for a in row.attachments] == [("image", "i1", 4), ("audio", "a1", 25), ("document", "d1", 768)] and row.attachment_tokens == 797
    assert all(row.formatted[a.place :].startswith(f"<|{a.kind}|>") for a in row.attachments)
    visitor = chat.Flatten()
    visitor.visit({"type": "video", "reference": "v"})
    assert visitor.attachments == [{"kind": "error", "reference": "unknown part type: video", "place": 0, "tokens": 0}] and visitor.text == ""


def test_typed_parts_with_broken_values(spark):
    half, long = chr(92) + "ud800", "9" * 400
    contents = [
        f'[{{"text": "a{half}b"}}, {{"type": "image", "reference": "r{half}"}}, {{"type": "{half}"}}]', f'[{{"type": "image", "reference": "i", "width": {long}, "height": {long}}}]',
        '[{"type": "audio", "reference": "a", "seconds": 1.7e308}, {"type": "document", "reference": "d", "pages": 1e308}]', '[{"type": "audio", "reference": "a", "seconds": Infinity}, {"type": "audio", "reference": "b", "seconds": NaN}]',
        '[{"type": "image", "reference": "i", "width": ' + "9" * 5000 + "}]",
    ]
    rows = [(k, 0, "user", c) for k, c in enumerate(contents)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect()}
    assert chat.read_turns(got[0].formatted)[0][1] == "a\ufffdb<|image|>" and [a.reference for a in got[0].attachments] == ["r\ufffd", "unknown part type: \ufffd"]
    assert [a.tokens for k in (1, 2, 3) for a in got[k].attachments] == [chat.MOST_TOKENS] * 3 + [1, 1]
    assert got[4].attachments[0].kind == "error" and "999" in got[4].formatted


def test_broken_pages():
    short = lambda page: [(p["kind"], p["text"] or p["digest"], p["caption"]) for p in media.parse_parts(page)]
    assert short('<figure><img src="d1"><figcaption>cap</figure><p>Text</p>') == [("image", "d1", "cap"), ("text", "Text", None)]
    assert short('<figure><img src="a"><figure><img src="b"><figcaption>in</figcaption></figure><figcaption>out<p>er</figcaption><img src=c></figure>x') == [("image", "a", "out er"), ("image", "b", "in"), ("image", "c", "out er"), ("text", "x", None)]
    assert short("<div><template>no<b></div>yes") == [("text", "yes", None)] and short("<noscript>no</noscript>yes<noscript>no") == [("text", "yes", None)]
    assert short("a<script>no") == [("text", "a", None)] and short("<figcaption>free &amp; easy</figcaption></figure></div>t") == [("text", "free & easy", None), ("text", "t", None)]
    assert short("<div><figure><img src=x alt='&lt;'></div>after<figcaption>own") == [("image", "x", "<"), ("text", "after", None), ("text", "own", None)]
    began = time.perf_counter()
    for page in ("<a " * 200_000, "<div>" * 200_000, "<figure><figcaption>" * 50_000, "</div>" * 200_000, "<img src=" * 100_000, "<" * 500_000, "<figure>" * 50_000 + "</div>" * 50_000):
        media.parse_parts(page)
    assert time.perf_counter() - began < 10


# ---------------------------------------------------------------- 9 shards


def test_parts_that_cannot_be_shown_are_recorded(spark):
    contents = ["no JSON", '{"type": "text"}', "[1, null]", '[{"type": "video", "reference": "v"}]', '[{"type": "image"}]', '[{"type": ["x"]}]', '[{"type": "image", "reference": "i", "width": null, "height": "big"}]', '"just a string"', None, "", '[{"type": "text", "text": 5}, {"text": "stays"}]', '[{"type": "audio", "reference": "a", "seconds": 1e300}]']
    rows = [(k, 0, "user", c) for k, c in enumerate(contents)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True).collect()}
    said = {k: chat.read_turns(r.formatted)[0][1] for k, r in got.items()}
    kinds = {k: [a.kind for a in r.attachments] for k, r in got.items()}
    assert said[0] == "no JSON" and kinds[0] == ["error"] and kinds[1] == ["error"] and kinds[2] == ["error", "error"]
    assert all(kinds[k] == ["error"] and said[k] == "" and got[k].attachment_tokens == 0 for k in (3, 4, 5))
    assert kinds[6] == ["image"] and got[6].attachment_tokens == 1 and said[7] == "just a string" and kinds[8] == kinds[9] == []
    assert said[10] == "stays" and kinds[10] == ["error"] and kinds[11] == ["audio"]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(spark, shards):
    rows = [*ODD[:-1], *[(100 + i, "same text" if i % 3 == 0 else words(i % 40, i)) for i in range(700)]]
    got = sharding.shard_by_bytes(docs(spark, rows), shards).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in texts[r.doc_id] for r in got)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in by[s]) - total / shards) <= largest for s in range(shards))
    whole = sharding.sharded(docs(spark, rows), shards)
    assert whole.count() == len(rows) and whole.columns == [*docs(spark, []).columns, "shard"]


# ---------------------------------------------------------------- 10 near copies


def brute_components(rows, n, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(ids[a]), find(ids[b])
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_components_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [r for r in ODD if r[0] is not None and r[0] != 4]
    base = [f"v{k}" for k in range(120)]
    for i in range(60):  # one group of near copies, from near to not near enough
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((100 + i, " ".join(w)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(12):  # each near the next, the ends far apart
        rows.append((300 + i, " ".join(chain[i * 5 : i * 5 + 90] + [f"t{k}" for k in range(i * 5)][-max(0, i * 5 - 60) :])))
    rows += [(400 + i, f"{words(40, 'common')} {words(30, f'own{i}')}") for i in range(60)]
    rows += [(500, rows[-1][1].upper()), (501, words(30_000) + " end")]
    got = near_dedup.near_duplicates(docs(spark, rows), n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.deduplicated(docs(spark, [*rows, (4, "a"), (4, "a")]), n=n)
    want = {i for i, (_, c) in brute_components([*rows, (4, "a")], n, 80).items() if i == c}
    assert sorted(r.doc_id for r in left.collect()) == sorted(want) and left.columns == docs(spark, []).columns


def sketched(spark, rows, n):
    """(nodes, sets, texts) as :func:`near_dedup.prefix_pairs` takes them, each row a group of its own."""
    texts = docs(spark, rows).select(F.col("doc_id").alias("__d"), "text")
    found = []
    for i, t in rows:
        values = near_dedup.shingles(common.Words(pa.array([t]), lower=True).hashes(), n)
        found.append((i, len(values), near_dedup.parity(values).tolist()))
    return texts.select("__d", F.col("__d").alias("__c")), spark.createDataFrame(found, "__d long, __n long, __bits array<long>"), texts


def links_of(rows, n):
    sets = {i: set(zip(*[t.split()[k:] for k in range(n)])) for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_prefix_pairs_lose_nothing(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        w = [f"b{k}" for k in range(60)]
        for k in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            w[k] = f"r{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    pairs = {(r["__a"], r["__b"]) for r in near_dedup.prefix_pairs(*sketched(spark, rows, 2), 2, 80).collect()}
    links = links_of(rows, 2)
    assert links and links <= pairs


def test_bound_of_sketches_loses_nothing(spark):
    """Sets of many sizes, so that sketches of two lengths meet: every link passes, and few others."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        size = int(rng.choice([100, 240, 270, 500, 520, 1100]))
        w = [f"b{k}" for k in range(size)]
        for k in rng.choice(size, int(rng.integers(0, size // 12)), replace=False):
            w[k] = f"r{i}_{k}"
        rows.append((i, " ".join(w)))
    _, sets, _ = sketched(spark, rows, 2)
    every = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "__a long, __b long")
    pairs = {(r["__a"], r["__b"]) for r in near_dedup.bounded(every, sets, 80).collect()}
    links = links_of(rows, 2)
    assert len(links) > 50 and links <= pairs and len(pairs) < 1.5 * len(links)


def test_near_copies_below_the_threshold_write_no_pairs(spark):
    """2,000 variants of one text, hardly any two of them similar enough: all pairs share tokens, hardly any is written."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        w = [f"b{k}" for k in range(120)]
        for k in rng.choice(120, 10, replace=False):  # other words are shared too, so no token is alone
            w[k] = f"r{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    pairs = near_dedup.prefix_pairs(*sketched(spark, rows, 2), 2, 80)
    assert pairs.count() <= 20 * len(rows)
    some = rows[:300]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, some), n=2).collect()}
    assert got == brute_components(some, 2, 80)


def test_a_row_repeated_often_is_one_document(spark):
    rows = [(1, words(40))] * 300 + [(2, words(40) + " more")] * 300 + [(3, "else")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert sorted(r.doc_id for r in near_dedup.deduplicated(docs(spark, rows)).collect()) == [1, 3]


def test_odd_rows(spark):
    got = near_dedup.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[0][0].n_shingles == 0 and by[0][0].component_id == 0 and by[3][0].component_id == by[4][0].component_id == 3
    assert all(r.component_id is None for r in by[None])
