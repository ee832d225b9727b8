"""Golden pages: selectors, bodies, cuts, heads; rules are data."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wikilake.functions import elements as E
from wikilake.operators import articles


def rows(spark, page):
    return spark.createDataFrame([(page,)], "html string").select(E.elements(F.col("html")).alias("rows"))


def test_elements_of_odd_pages(spark):
    page = '<p>a<p>b<b>c\n<ul><li>1<li>2<ul><li>3</ul></ul>d<br/><img src="x>y">\n<div class=" u  v " id=k hidden>é😀</i>'
    found = rows(spark, page).first().rows
    assert [(e.tag, list(e.path)) for e in found] == [("p", [0]), ("p", [1]), ("b", [1, 2]), ("ul", [3]), ("li", [3, 4]), ("li", [3, 5]), ("ul", [3, 5, 6]), ("li", [3, 5, 6, 7]), ("br", [8]), ("img", [9]), ("div", [10])]
    assert page[found[3].begin : found[3].stop] == "<ul><li>1<li>2<ul><li>3</ul></ul>" and page[found[5].begin : found[5].stop] == "<li>2<ul><li>3</ul>"
    assert found[10].id == "k" and found[10].classes == ["u", "v"] and found[10].chars == 2 and found[10].stop == len(page) and found[9].attrs == {"src": "x>y"}
    assert found[2].stop == page.index("<ul>") and found[3].chars == 3
    assert [r.rows for r in spark.createDataFrame([(None,), ("",), ("no tags",)], "html string").select(E.elements(F.col("html")).alias("rows")).collect()] == [[], [], []]


@pytest.mark.parametrize(
    ("selector", "want"),
    [("p", "abc"), ("main p", "bc"), ("main .x p", "c"), (".x", "M"), (".x.y", "M"), ("div.y", "M"), ("#one", "a"), ("[data-k]", "b"), ("[data-k='v w']", "b"), ("[data-k*='w']", "b"), ("[data-k^='w']", ""), ("[data-k$=\"w\"]", "b"), ("[class*='yy']", "c"), ("main main p", ""), ("body   main  div p", "c"), ("[data-k~=w]", "b")],
)
def test_selectors(spark, selector, want):
    page = '<body><p id="one" title="a">a</p><main><p title="b" data-k="v w">b</p><div class="x y" title="M"><p title="c" class="ayyb">c</p></div></main></body>'
    hits = E.selected(F.col("rows"), E.parsed(F.lit(selector)))
    assert "".join(x.attrs["title"] for x in rows(spark, page).select(hits.alias("h")).first().h) == want


def test_shared_prefixes(spark):
    rng = random.Random(1)
    sets = [[[rng.randrange(3) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 5))] for _ in range(200)] + [[[1]], [[1, 2], [1, 2]]]
    got = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, s array<array<int>>")
    exploded = got.select("k", F.explode("s").alias("p")).groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("b")).select("k", E.shared_prefix(F.col("a"), F.col("b")).alias("x"))
    for df in (got.select("k", E.common_ancestor(F.col("s")).alias("x")), exploded):
        for r in df.collect():
            assert r.x == [v[0] for v in itertools.takewhile(lambda v: len(set(v)) == 1, zip(*sets[r.k]))]


LONG = "word " * 50


def article(spark, html, url="https://blog.csdn.net/x", rules=None):
    pages = spark.createDataFrame([(1, url, html, "x")], "page_id int, url string, html string, site string")
    return articles.articles(pages, articles.site_rules(spark) if rules is None else spark.createDataFrame(rules, "site string, action string, place int, value string")).first()


def test_a_golden_page(spark):
    page = f"""<html><head><title>doc</title><meta property="og:title" content="A &amp; B - CSDN博客"><meta name="author" content="Ann"><meta property="article:author" content="Bob"><meta name="author" content="Ann">
<meta property="article:published_time" content="2024-05-06T07:08"><meta property="og:description" content="what it is"></head><body><nav>menu</nav><article>outside<div id="content_views"><h2>Head</h2><p>{LONG}</p>
<div class="recommend-box">gone<nav>in it</nav></div><p>**x** <b>bold</b>word</p><img srcset="s.png 100w, l.png 900w" src="s.png" alt="q&quot;"></div></article></body></html>"""
    got = article(spark, page)
    assert (got.site, got.title, got.description, got.published, got.authors) == ("blog-csdn", "A & B", "what it is", "2024-05-06", ["Ann", "Bob"])
    assert got.markdown == f'# A & B\n\n> 原文链接: https://blog.csdn.net/x\n> 作者: Ann, Bob\n> 发表于: 2024-05-06\n> what it is\n\n---\n\n## Head\n\n{LONG.strip()}\n\n**x** **bold** word\n\n![q"](l.png)\n'


def test_bodies(spark):
    cards = "".join(f"<article class='card'>{k} {LONG}</article>" for k in "abc")
    listing = article(spark, f"<body><header>h</header><div id='list'>intro {cards}</div></body>", "https://anthropic.com/news")
    assert listing.body.startswith("intro") and all(f"{k} word" in listing.body for k in "abc")
    two = article(spark, f"<body>intro <article>a {LONG}</article><article>b {LONG}</article></body>", "https://anthropic.com/news")
    assert two.body.startswith("a word") and "b word" not in two.body
    wide = article(spark, f"<html><body><p>lead</p><div>{cards}</div></body></html>", "https://anthropic.com/x")
    assert "lead" not in wide.body and "c word" in wide.body  # the tightest holder
    apart = article(spark, f"<html><body><div><article>a {LONG}</article></div><article>b {LONG}</article><article>c {LONG}</article></body></html>", "https://anthropic.com/x")
    assert "a word" in apart.body and "b word" not in apart.body  # not the whole page: its part towards the first
    short = article(spark, "<body><p>x</p><main>m</main><article>tiny</article></body>", "https://anthropic.com/x")
    assert short.body == "tiny"
    assert article(spark, "bare text", "https://anthropic.com/x").body == "bare text" and article(spark, "", "https://anthropic.com/x").title == "(anthropic article)"
    none = article(spark, None, None)
    assert (none.site, none.body, none.title) == ("_default", "", "(default article)")
    lazy = article(spark, f"""<article>{LONG}<img data-loading='{{"mobile":"m.png","desktop":"d.png"}}' src="t.png"><img data-loading='broken' src="u.png"></article>""", "https://blog.google/x")
    assert "![](d.png)" in lazy.body and "![](u.png)" in lazy.body and "t.png" not in lazy.body
    assert "## Section" in article(spark, f"<div class='prose'><h1>Section</h1>{LONG}<h2 id='x'>Sub</h2></div>", "https://aleksagordic.com/x").body


def test_rules_are_data(spark):
    page = f"<body><div class='a'>first {LONG}<svg><text>t</text></svg><i class='no'>bad</i></div><div class='b'>second {LONG}</div></body>"
    rules = [("_default", "body", 0, ".a"), ("_default", "body", 1, ".b"), ("_default", "drop", 0, ".no"), ("_default", "replace", 0, "svg => (a figure)")]
    got = article(spark, page, "https://h.org/", rules)
    assert got.body.startswith("first") and "(a figure)" in got.body and "bad" not in got.body
    swapped = [("_default", "body", 1, ".a"), ("_default", "body", 0, ".b"), *rules[2:]]
    assert article(spark, page, "https://h.org/", swapped).body.startswith("second")
    assert "bad" in article(spark, page, "https://h.org/", rules[:2]).body
    own = [*rules, ("lmsys", "body", 0, ".b"), ("lmsys", "title", 0, r" \| X$")]
    assert article(spark, page, "https://lmsys.org/", own).body.startswith("second") and article(spark, page, "https://h.org/", own).body.startswith("first")
    assert {r.site for r in articles.site_rules(spark).select("site").distinct().collect()} == set(articles.SITES)


def test_references_count_with_their_semicolon():
    """A reference that was cut off stays as it stands, in texts, titles and attributes."""
    from wikilake.functions import elements, markdown

    page = "<title>a &amp</title><p>x &amp; y &ampz; &#65; &#65 <a href='/u?a=1&copy=2&amp;d=3'>l</a></p>"
    assert markdown.to_markdown(page) == "a &amp\n\nx & y &ampz; A &#65 [l](/u?a=1&copy=2&d=3)"
    title, p, a = elements._Reader(page).rows
    assert title["attrs"]["#text"] == "a &amp" and title["chars"] == 6
    assert p["begin"] == page.index("<p>") and p["chars"] == len("x & y &ampz; A &#65 l")
    assert a["attrs"]["href"] == "/u?a=1&copy=2&d=3"
