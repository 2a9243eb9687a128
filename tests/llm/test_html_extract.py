"""Main text of pages: messages against sums over all labellings, trees against worked cases, extraction against held-out labelled pages and the given ones."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from llm.html_extract import extracted, labelled, labels, main_texts, train
from llm.html_model import KINDS, Forest, depths
from llm.html_pages import labelled_page
from llm.html_tree import Tree, features, joined

SF = "/root/testdata/sf0.01"


def test_marginals_equal_sums_over_all_labellings():
    r = np.random.default_rng(2)
    for _ in range(20):
        n = int(r.integers(1, 9))
        parent = np.array([-1] + [-1 if r.random() < 0.2 else int(r.integers(0, i)) for i in range(1, n)])
        kind, own, edge = r.integers(0, KINDS, n), r.normal(0, 2, n), r.normal(0, 2, (KINDS, 2, 2))
        weight, one, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(own[i] * y[i] + (edge[kind[i], y[parent[i]], y[i]] if parent[i] >= 0 else 0) for i in range(n)))
            weight += w
            one += w * np.array(y)
            for i in range(n):
                if parent[i] >= 0:
                    pairs[i, y[parent[i]], y[i]] += w
        p, joint, total = Forest(parent, kind).marginals(own, edge)
        assert np.allclose(p, one / weight) and np.allclose(joint, pairs / weight) and np.isclose(total, np.log(weight))


def test_depths_of_a_long_chain():
    n = 50_000
    assert (depths(np.arange(-1, n - 1)) == np.arange(n)).all()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p><b>one<br><p>two</p>", "one\n\ntwo"),
        ("<p>a<b>b</b> <i>c</i>d<br>e</p>tail", "ab cd e\n\ntail"),
        ("&lt;p&gt; &amp;amp; &eacute;&#233;&nbsp;x", "<p> &amp; éé x"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- no --><title>t</title>", "x"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<h2>t</h3>x</div></p>y", "t\n\nx\n\ny"),
        ("a<br/>b<img src=x>c<input value=d>", "a bc"),
        ("<p>un<", "un<"),
    ],
)
def test_blocks_of_trees(page, text):
    t = Tree(page)
    assert joined(t, [True] * len(t.tag)) == text
    assert len(features(t)) == len(t.tag)


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + "x" + "</p>" * 10
    t = Tree(deep)
    assert joined(t, [True] * len(t.tag)) == "x"
    wide = Tree("<p>" + "word " * 400_000 + "<b>" * 2000 + "<p>y" * 2000)
    assert sum(map(len, wide.piece)) >= 2_000_000


def test_labels_follow_their_elements():
    t = Tree('<div data-label="1">aaa<p data-label="0">b</p></div><p>c</p>')
    got = labels(t)
    assert {t.piece[i]: got[i] for i in range(len(got)) if t.tag[i] == "#"} == {"aaa": 1, "b": 0, "c": 0}
    assert got[0] == 1 and t.names == [()] * len(t.names)


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled(spark.read.parquet(f"{SF}/documents.parquet")))


def truth(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_articles_of_the_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in extracted(pages.selectExpr("*", "1 as text", "2 as N_CHARS"), model).collect()}
    given = pages.collect()
    assert len(got) == len(given) and all(got[r["page_id"]]["url"] == r["url"] for r in given)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert sum(got[r["page_id"]]["text"] == truth(r["html"]) for r in given) >= 0.99 * len(given)


def test_held_out_pages_of_other_kinds(model):
    """Pages that the model hasn't seen, of the many kinds that it learns from: letters of articles found, and of what is kept."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 9))) for _ in range(500)]
    pages = [labelled_page("\n".join(" ".join(r.choices(words, k=r.randint(3, 60))) + "." for _ in range(r.randint(1, 9))), 10**6 + k) for k in range(200)]
    both = kept = all_ = 0
    for page, text in zip(pages, main_texts(pages, model), strict=True):
        t = Tree(page)
        want = joined(t, t.label)
        blocks = set(want.split("\n\n"))
        both += sum(len(b) for b in text.split("\n\n") if b in blocks)
        kept += len(text)
        all_ += len(want)
    assert both >= 0.93 * all_ and both >= 0.93 * kept


PAGE = """<html><body><header class="site-header"><a href="/">Site</a></header><nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies. By staying you agree to them.</div><div class="wrapper"><aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One thing</a>
<li><a href=/2>Another thing</a></ul></aside><div class="article-body"><h1>A title</h1><p>First paragraph &amp; more, of some length, so that it looks like prose.</p>
<div class="advert">Buy this now, it is very good.</div><p>Second paragraph, also of some length, with a <a href=/l>link</a> in it.</p></div>
<section id="comments"><h3>Comments</h3><ul><li>Nice article, I liked it a lot.</li></ul></section></div><form class="newsletter"><label>Mail</label><input><button>Go</button></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_a_page_with_all_parts(model):
    want = "A title\n\nFirst paragraph & more, of some length, so that it looks like prose.\n\nSecond paragraph, also of some length, with a link in it."
    assert main_texts([PAGE], model) == [want]


def test_edges(spark, model):
    kind = "page_id long, url string, html string"
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<article><p>Alone.</p></article>")]
    out = sorted(map(tuple, extracted(spark.createDataFrame(rows, kind), model).collect()), key=repr)
    assert out == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "", 0), (2, "u", "Alone.", 6)], key=repr)
    assert extracted(spark.createDataFrame([], kind), model).count() == 0
    untaught = train(labelled(spark.createDataFrame([], "doc_id long, text string")))
    assert extracted(spark.createDataFrame(rows, kind), untaught).count() == 4


def test_registered_query(spark):
    from llm.catalog import op12_html_extraction

    df = op12_html_extraction(spark, "/root/testdata/sf0.001")
    assert df.columns == ["page_id", "url", "text", "n_chars"] and df.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
