import html
import re

import numpy as np
import pytest

from cohortfold.llm import html_crf, queries
from cohortfold.llm.html_blocks import blocks

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return html_crf.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_query_gives_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    told = queries.op1_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(told) == len(pages)
    for r in told:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<(?!/?b\b)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_layouts(spark, model):
    rng = np.random.default_rng(99)
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(40).collect()
    right = total = 0
    for r in rows:
        found, labels = html_crf.marked(r.html)
        main, other = ([b.text for b, y in zip(found, labels) if y == k] for k in (1, 0))
        laid, want = html_crf.lay_out(main[:30], other + main, rng)
        got = model.decode([sum(model.weights.get(f, 0.0) for f in row) for row in html_crf.block_features(blocks(laid))])
        right, total = right + sum(a == b for a, b in zip(got, want)), total + len(want)
    assert right / total > 0.97


def test_a_page_of_another_kind(model):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>The Daily</h1></header>
    <nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <main><h1>A title</h1><p>First   paragraph of &eacute;t&eacute; &amp; more<br>goes on<script>var a="<p>no</p>"</script>.<p>Second <i>one</i> is here, with a <a href=#>link</a>.</main>
    <aside class=sidebar><p>Related stories of the week.</p></aside><form><label>Mail</label><input><button>Send</button></form>
    <section class="comments"><p>Great read, I liked the second part of it very much.</p></section><footer>&copy; 2020 The Daily</footer></body></html>"""
    assert model.main_text(page) == "A title First paragraph of été & more goes on. Second one is here, with a link."


def test_edges(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string, _block int"
    pages = spark.createDataFrame([(1, None, None, "t", "n", 1), (2, "u", "", None, None, None), (3, "u", "<article>x < y <b>bold</b>ly &lt;z&gt; &am", "t", "n", 1),
                                   (4, "u", "<article>" + "<p>word " * 20_000, "t", "n", 1), (4, "u", "<script>only", "t", "n", 1), (None, "u", "<div " * 5000, "t", "n", 1)], schema)
    told = html_crf.extract(pages, model)
    assert told.columns == ["page_id", "url", "text", "n_chars"] and told.count() == 6
    got = sorted(((r.page_id or 0, r.text) for r in told.collect()), key=lambda x: (x[0], len(x[1])))
    assert got[1:5] == [(1, ""), (2, ""), (3, "x < y boldly <z> &am"), (4, "")] and got[5] == (4, " ".join(["word"] * 20_000))
    assert html_crf.extract(pages.limit(0), model).count() == 0
    none = html_crf.fit(pages.limit(0))
    assert none.main_text("<article><p>Some text of an article.</p></article>") == "Some text of an article."


def test_elements_without_text_and_without_end():
    read = lambda page: [b.text for b in blocks(page)]
    for tag in ("svg", "canvas", "audio", "video", "noscript", "iframe", "object", "math"):
        assert read(f"<p>Before.</p><{tag}><p>After</p><{tag}>it.") == ["Before.", "After", "it."]
    for tag in ("svg", "canvas", "audio", "video", "noscript", "iframe"):
        assert read(f"<p>Before <{tag} class=a>none<b>of</b></{tag.upper()} >it.") == ["Before it."]
    for tag in ("script", "style", "textarea", "title", "template"):
        assert read(f"<p>Before.<{tag}>rest <p>of the page") == ["Before."]
    assert read("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>x=2</annotation></math> holds.") == ["As x=2 holds."]
    assert read("<p>See <object data=f>the <i>file</i></object>.") == ["See the file."]
    assert len(read("<svg><p>a" * 20_000)) == 20_000


def test_viterbi_is_the_best_sequence():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(20):
        crf = html_crf.Crf({}, rng.standard_normal((2, 2)), rng.standard_normal(2))
        scores = rng.standard_normal(7).tolist()
        total = lambda ys: crf.begin[ys[0]] + sum(s * y for s, y in zip(scores, ys)) + sum(crf.steps[a, b] for a, b in zip(ys, ys[1:]))  # noqa: E731,B023
        assert tuple(crf.decode(scores)) == max(product((0, 1), repeat=7), key=total)
