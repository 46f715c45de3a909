"""WARC archives and page extraction."""

import base64
import hashlib
import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import html_extract, warc
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = [(1, "http://a.b/c", "x"), (2, "http://a.b/c", "x"), (2, None, "x"), (None, "http://a.b/c", "x"), (3, "junk\r\nline", ""), (4, "http://u@A.B:80/c?q=1", None), (3, "junk\r\nline", ""), (5, "https://é.example/", "ü\r\n\r\n\x00" * 9000), (None, None, "only")]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit(1), "sha1": F.lit(2), "file": F.lit(3), "response": F.lit(4)})
    got = warc.archive_and_read(df, f"file://{tmp_path}/w").collect()
    largest = {}
    for i, _, h in PAGES:
        largest[h or ""] = max([x for x in (largest.get(h or ""), i) if x is not None], default=None)
    want = Counter()
    for i, _, h in PAGES:
        data, top = (h or "").encode(), largest[h or ""]
        response = i == top or top is None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top, data if response else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_index_finds_single_keys_and_misses(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i % 50}", f"page {i}") for i in range(2_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archive(df, f"{tmp_path}/archive")
    index = warc.build_index(captures, f"{tmp_path}/index", f"{tmp_path}/archive", n_ranges=3)
    asked = df.where("page_id in (0, 77, 1999)").select(warc.surt(F.col("url")).alias("key"), "page_id")
    missing = spark.createDataFrame([("zz", 1), ("", None), ("example,h1)/5", 10**9)], "key string, page_id long")
    got = warc.read_captures(asked.unionByName(missing), index).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, f"page {i}") for i in (0, 77, 1999)]


def test_surt(spark):
    urls = ["http://www.A.org:80/p?q", "https://user@x.y/", "nothing", None, "http://h"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.surt(F.col("u")).alias("k")).collect()]
    assert got == ["org,a,www)/p?q", "y,x)/", "nothing", "", "h)"]


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in parts if x)


def test_extraction_equals_the_articles(spark):
    got = {r.page_id: r for r in QUERIES["op8_html_extract"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    right = [got[p.page_id].text == article(p.html) for p in pages]
    assert np.mean(right) >= 0.98 and all(r.n_chars == len(r.text) for r in got.values())


def test_extraction_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>unclosed <b>bold<p>next &amp; more"), (4, "<script>if (a < b) '</p>'"), (5, "plain < text > only"), (6, "<div " + "x" * 10_000), (7, "<article>" + "<p>many words here.</p>" * 3_000 + "</article>"), (7, "<article><p>again</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"main_text": F.lit(1), "id": F.lit(2)})
    model = html_extract.fit(df)
    got = html_extract.extract_pages(df, model).collect()
    assert len(got) == len(rows) and all(isinstance(r.main_text, str) for r in got)
    assert [r.main_text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html_extract.extract_pages(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_blocks_follow_the_markup():
    page = '<html><head><title>t</title></head><body><nav><a href="/">n</a></nav><div class="main"><h1>A &lt; B</h1><p>one <b>two</b>\n three<br>four<p>five<!-- no --></div><script>x("<p>")</script></body>'
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["n", "A < B", "one two three four", "five"]
    assert found[0].linked == 1.0 and found[1].path[-2] == ("div", "main")


def test_omitted_end_tags():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    body = "<article><h1>A</h1><p>one<p>two</article>"
    for head in ("<head><title>x</title>", "<head><title>x</title><meta charset=a><link href=b>", "<head><title>x", "<head><title>x <b>y</title><style>p {}</style>", "<head><title>x</title><noscript><img></noscript><script>a</script>"):
        assert texts(f"<html>{head}<body>{body}") == ["A", "one", "two"]
        if head.count("title") != 1:
            assert texts(f"<html>{head}{body}") == ["A", "one", "two"]
    assert texts(f"<head><title>x{body}") == ["A", "one", "two"]
    assert texts("<head><title>x</title> plain <b>text</b>") == ["plain text"]
    assert texts("<head><title>x</title><span>a</span> b") == ["a b"]
    assert texts("<p>a<svg><title>s</title></svg><p>b") == ["a", "b"]


def test_extraction_without_optional_end_tags(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.fit(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "(?i)</(head|body|html|p|li)>", ""))
    whole = {r.page_id: r.main_text for r in html_extract.extract_pages(pages, model).collect()}
    got = [r.main_text == whole[r.page_id] for r in html_extract.extract_pages(bare, model).collect()]
    assert np.mean(got) >= 0.98


def test_gradients():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller.fresh()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, lengths = html_extract._padded([rng.standard_normal((n, html_extract.INPUT)) for n in (3, 5)])
    y = (rng.random(x.shape[:2]) > 0.5).astype(float)

    def loss():
        p = model._forward(x, lengths)[0]
        inside = np.arange(x.shape[1]) < lengths[:, None]
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * inside).sum() / inside.sum()

    for name, g in model._gradients(x, lengths, y).items():
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-3
        up = loss()
        model.weights[name][at] = old - 1e-3
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3 * max(1e-2, abs(g[at])) + 1e-5


def test_new_layouts_leave_the_rest_out(spark):
    """Trained labeller on layouts it has not seen: nearly all blocks right."""
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    rng = np.random.Generator(np.random.PCG64(99))
    right = total = 0
    for _ in range(60):
        page, main = html_extract.redressed([f"Sentence number {i} tells a story at some length." for i in range(5)], ["Home", "Contact us", "Read more about it", "Terms of use"], rng)
        found = html_extract.blocks(page)
        chance = model.chances([html_extract.vectors(found)])[0]
        truth = np.array([b.text in main and not ({w for p in b.path for w in p} & {"comment", "aside"}) for b in found])
        right += ((chance > 0.5) == truth).sum()
        total += len(found)
    assert right / total > 0.97


def test_layouts_written_by_hand(spark):
    """Whole main text of pages that no training layout looks like."""
    from tests.llm.hand_layouts import LAYOUTS

    model = html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    df = spark.createDataFrame([(i, page) for i, (_, page, _) in enumerate(LAYOUTS)], "page_id long, html string")
    got = {r.page_id: r.main_text for r in html_extract.extract_pages(df, model).collect()}
    assert np.mean([got[i] == want for i, (_, _, want) in enumerate(LAYOUTS)]) >= 0.9


def test_training_pages_are_bounded(spark):
    df = spark.createDataFrame([(i, f"<p>{i}</p>" + "x" * 90) for i in range(50)] + [(3, "<p>other</p>"), (None, "n"), (4, None)], "page_id long, html string")
    pages = lambda n, most: html_extract.training_pages(df, "html", "page_id", n, most)
    assert len(pages(300, 1 << 20)) == 50 and len(pages(10, 1 << 20)) == 10
    assert sum(map(len, pages(300, 1_000))) <= 1_000 and pages(300, 10) == []
