"""The trained operators: quality, URL filter, HTML extraction; and nearest neighbours."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.corpus import TEXT_SCHEMA, awkward, paragraph, sentence
from pyspark.sql import functions as F

from tablewright.llm import html_text, nearest, quality, url_filter
from tablewright.llm import words as words_module
from tablewright.llm.words import words

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 50
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored]) >= 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in awkward()], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, 1), (1, 1), (42, 0), (2, None), (3, 7), (None, 1), (999, 0), (0, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(awkward()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    untrained = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, untrained).collect()} == {0.5}
    assert quality.score(docs.limit(0), untrained).count() == 0


def packed_examples(rows):
    return pa.Table.from_batches([quality._packed(pa.record_batch([[r[i] for r in rows] for i in range(3)], ["__id", "__y", "__text"]))])


def test_packed_examples_train_the_model_of_plain_ones():
    rng = random.Random(4)
    rows = [(i % 40, float(i % 3 == 0), paragraph(rng)) for i in range(90)]  # ids with other texts and the same label
    rows += [(90, 1.0, ""), (91, 0.0, "x"), (92, 1.0, "a b " * 40_000), (93, 0.0, " ".join(map(str, range(20_000)))), rows[0]]

    def plain(text):
        found = words(pa.array([text]), lower=False)
        which, count = np.unique(quality._buckets(found), return_counts=True)
        return which.astype(np.int32), (count * (quality.SCALE / max(len(found.starts), 1))).astype(np.float32)

    examples = sorted(((zlib.crc32(str(i).encode()), y, *plain(text)) for i, y, text in rows), key=lambda e: (e[0], e[1], e[2].tobytes()))
    want = quality._updates(lambda: ((np.append(at, quality.BUCKETS), np.append(x.astype(float), 1.0), y) for _, y, at, x in examples))
    for order in (rows, rows[::-1]):
        got = quality._fitted(packed_examples(order))
        assert np.array_equal(got.weights, want.weights) and got.bias == want.bias


def test_fitting_unpacks_one_example_at_a_time():
    rng = np.random.default_rng(5)
    table = packed_examples([(i, float(i % 2), " ".join(map(str, rng.integers(0, 1 << 30, 4000)))) for i in range(300)])
    n = sum(table["many"].to_pylist())
    assert table.nbytes < 5 * n  # eight bytes a feature when they were sent unpacked
    tracemalloc.start()
    quality._fitted(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * n  # copies of all examples took 28 bytes a feature


def test_scoring_and_packing_read_little_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10_000, 200))) for _ in range(1_000)] + [None, ""])  # 1 MB
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([1.0] * len(texts)), texts], names=["__id", "__y", "__text"])
    model = quality.Model(rng.random(quality.BUCKETS), 0.5)
    calls, most = (lambda: model.margins(texts), lambda: quality._packed(batch)), []
    for call in calls:
        tracemalloc.start()
        call()
        most.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(most) < 16, most  # MB; 39 when features of all were made at once
    margins, packed = (call() for call in calls)
    monkeypatch.setattr(quality, "READ", 10_000_000)
    assert np.array_equal(margins, model.margins(texts)) and packed.equals(quality._packed(batch))
    assert len(model.margins(texts.slice(0, 0))) == 0


def test_hashes_do_not_depend_on_blocks_and_keep_little(monkeypatch):
    text = pa.array([" ".join(map(str, range(300_000))), "x" * 700_000, "a b", None])
    monkeypatch.setattr(words_module, "_powers", [])
    found = words(text.slice(0, 1), lower=False)
    assert sum(p.nbytes for p in words_module._powers) < 5_000_000  # what a worker keeps; 16.8 MB with blocks of 1 MB
    every = words(text, lower=False)  # a word longer than a block among them
    monkeypatch.setattr(words_module, "_BLOCK", 1 << 22)
    assert np.array_equal(words(text, lower=False).hashes, every.hashes) and np.array_equal(every.hashes[: len(found.hashes)], found.hashes)


def test_held_out_is_the_crc(spark):
    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
URLS = [
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/17?x=/es/", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/#a", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://casino-bets.com/de/9", "casino-bets.com", "/de/9", "com/de/", "block"),
    ("http://free-casino-bets.example.net/en/9", "free-casino-bets.example.net", "/en/9", None, "block"),
    ("http://library-news.example.net/en/9", "library-news.example.net", "/en/9", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://a.org?x://b.com/", "a.org", "", None, "allow"),
    ("no scheme/fr/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], 5) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_the_url_model_fits_its_table():
    import pyarrow as pa

    table = url_filter.examples()
    margins = url_filter._margins(*url_filter.model(), *(pa.array([e[i] for e in table], pa.string()) for i in (0, 1)))
    assert np.mean((1 / (1 + np.exp(-margins)) >= url_filter.BLOCK) == [e[2] for e in table]) > 0.97


PAGES = [
    ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three.<p>Four <b>five</b>.</article><footer>&copy; x</footer>", "A & B\nOne two three.\nFour five."),
    ("<body><div class='cookie-notice'>We use cookies.</div><main><p>The text is here, and it goes on.</p><div class=ad>Buy</div><p>More of it.</p></main><section class=comments><p>I liked it. Very much.</p></section></body>", "The text is here, and it goes on.\nMore of it."),
    ("<article><p>Kept.</p><script>var t = '</p>';</script><style>p{}</style><!-- no --><p>Also &lt;kept&gt;.</p></article>", "Kept.\nAlso <kept>."),
    ("", ""), (None, ""), ("<html><body></body></html>", ""), ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav><footer>&copy; x</footer>", ""),
]


def test_html_pages(spark):
    df = spark.createDataFrame([(i, p[0], "old") for i, p in enumerate(PAGES)], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert {r.page_id: r.text for r in out.collect()} == {i: p[1] for i, p in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_long_and_broken_pages():
    weights, move = html_text.model()
    rng = random.Random(1)
    lines = [sentence(rng, 12) + "." for _ in range(3000)]
    assert html_text.main_text("<article>" + "".join(f"<p>{x}" for x in lines), weights, move) == "\n".join(lines)
    for broken in ("<", "<p", "<article><p>x", "</p></p>", "<a href='", "<!--", "<script>", "a<b"):
        assert isinstance(html_text.main_text(broken, weights, move), str)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        unary, move = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        score = lambda y: sum(unary[i][a] for i, a in enumerate(y)) + sum(move[a][b] for a, b in zip(y, y[1:]))
        every = [[(k >> i) & 1 for i in range(6)] for k in range(64)]
        assert np.isclose(score(html_text.decode(unary, move)), max(map(score, every)))


def test_extraction_on_the_pages_table(spark):
    got = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")).collect()
    assert len(got) == 250 and all(r.text and "©" not in r.text and "track(" not in r.text for r in got)


def brute_nearest(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if q in queries:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, pytest.approx(d, abs=1e-12)) for r, (d, i) in enumerate(near, 1)]
    return sorted(out, key=lambda r: r[:2])


def test_nearest_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # a hot vector
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (None, rows[0][1]), (600, [1.0, 2.0]), (601, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(df, F.col("vec_id") % 50 == 0).collect()), key=lambda r: r[:2])
    assert got == brute_nearest(rows, set(range(0, 700, 50)), 10)


def test_nearest_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    wanted = {(q, i) for q, _, i, _ in brute_nearest(rows, set(range(0, 10_000, 20)), 10)}
    got = {(r.query_id, r.vec_id) for r in nearest.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert len(got & wanted) >= 0.99 * len(wanted)


def test_nearest_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, pytest.approx(2**0.5))]
    assert nearest.search(df, F.col("vec_id") == 9).count() == 0
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries, centre = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64)), rng.normal(size=64) * 0.1
    low, high = nearest.bounds(queries, centre, *nearest.code(vectors, centre))
    true = ((queries[:, None] - vectors) ** 2).sum(2)
    assert np.mean((low <= true + 1e-3) & (true <= high + 1e-3)) > 0.999


def test_paragraph_helper_is_prose():
    assert paragraph(random.Random(1)).count("\n") == 5 and TEXT_SCHEMA


def test_raw_text_never_leaks():
    weights, move = html_text.model()
    for script in ("<script src=/x/>", "<script src='x' />", "<script/>", "<SCRIPT src=x/ >", "<style/>", "<textarea />", "<title/>"):
        name = script[1:].split()[0].strip("/>").lower()
        page = f"<article><p>One line of text that stays, as it should.</p>{script}var leak = 1; track();</{name}><p>Another line of text that stays.</p></article>"
        assert html_text.main_text(page, weights, move) == "One line of text that stays, as it should.\nAnother line of text that stays."


def test_deep_pages_take_seconds():
    import time

    weights, move = html_text.model()
    pages = ("<div>" * 200_000, "<div>x" * 30_000, "<span>" * 60_000 + "<p>x" * 20_000, "<a>" * 60_000 + "</b>" * 60_000, "<p>x</p>" * 30_000, "<div><span class=c>" * 30_000 + "x")
    for page in pages:
        begin = time.process_time()
        html_text.main_text(page, weights, move)
        assert time.process_time() - begin < 10, page[:30]


def test_blocks_equal_an_independent_parser():
    """The text of every block, against Python's own HTML parser on the test pages."""
    import html.parser

    import pyarrow.parquet as pq

    class Texts(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.texts, self.raw = [], [], 0

        def cut(self):
            if text := " ".join("".join(self.parts).split()):
                self.texts.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK:
                self.cut()
            elif tag == "br":
                self.parts.append(" ")
            self.raw += tag in html_text.RAW

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.cut()
            self.raw -= tag in html_text.RAW

        def handle_data(self, data):
            if self.raw <= 0:
                self.parts.append(data)

    for page in pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist():
        parser = Texts()
        parser.feed(page)
        parser.close()
        parser.cut()
        assert [b.text for b in html_text.blocks(page)] == parser.texts
