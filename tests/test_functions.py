"""Columns on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.functions import pdf as P
from wikilake.functions import text as T
from wikilake.functions import urls as U
from wikilake.operators import curation, quality


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (" HTTP://EXAMPLE.org/a/?utm_source=x&b=2&a=1#top ", "http://example.org/a?a=1&b=2"),
        ("https://h.org", "https://h.org/"),
        ("https://h.org/?ref=a", "https://h.org/"),
        ("https://h.org/A?z=1&b=2&b=1", "https://h.org/A?b=2&b=1&z=1"),
        ("MAILTO:a@b.c", "mailto:a@b.c"),
        ("no url", "no url"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize_url(F.col("c0")), url) == want


def test_hosts(spark):
    assert one(spark, U.hostname_of(F.col("c0")), "https://WWW.h.org:8080/x") == "www.h.org"
    assert one(spark, U.host_of(F.col("c0")), "https://WWW.h.org:8080/x") == "h.org"
    assert one(spark, U.is_lan(F.col("c0")), "http://10.0.0.1/x") is True
    assert one(spark, U.unwrap_share_url(F.col("c0")), "https://share.google/?link=https%3A%2F%2Fa.b%2Fc") == "https://a.b/c"
    assert one(spark, U.route_site(F.col("c0")), "https://www.github.com/a/b") == "github"
    assert one(spark, U.route_site(F.col("c0")), "nothing") == "_default"
    assert one(spark, U.resolve_against(F.lit("https://h.org/a/b/c.html"), F.col("c0")), "../i.png") == "https://h.org/a/i.png"


@pytest.mark.parametrize("ref", ["i.png", "./i.png", "../../i.png", "../../../../i.png", "a/./b/../c.png?x=1#y", "?q=2", "#f", "", "/r/../s.png", "//o.org/x", "https://z/", ".."])
def test_references_resolve_as_urls_do(spark, ref):
    from urllib.parse import urljoin

    base = "https://h.org/a/b/c.html?k=1"
    assert one(spark, U.resolve_against(F.lit(base), F.col("c0")), ref) == urljoin(base, ref)


WIKI = "---\ntype: entity\ncreated: 2024-01-02\n---\n# Name\nSee [[A]] and [[B|b]].\n```\n[[C]]\n```\n## Synthesis\ntbd\n## Observations\n- one [[A]]\n- two\n"


def test_pages(spark):
    c = F.col("c0")
    assert one(spark, T.wikilinks(c), WIKI) == ["A", "B"]
    assert one(spark, T.frontmatter_map(c), WIKI) == {"type": "entity", "created": "2024-01-02"}
    assert one(spark, T.body(c), WIKI).startswith("# Name")
    assert one(spark, T.section(c, "Observations"), WIKI) == "- one [[A]]\n- two"
    assert one(spark, T.section(c, "Nothing"), WIKI) is None
    assert one(spark, F.size(T.observations(c)), WIKI) == 2
    assert one(spark, T.is_stub(T.section(c, "Synthesis")), WIKI) is True
    assert one(spark, T.rewrite_links(c, "B", "Z"), WIKI).count("[[Z|b]]") == 1
    assert one(spark, curation.with_section(c, "Synthesis", F.lit("new")), WIKI).split("## Synthesis\n")[1].startswith("new\n## Observations")


def test_null_and_empty_text(spark):
    for value in (None, ""):
        assert one(spark, F.coalesce(F.size(T.wikilinks(F.col("c0"))), F.lit(0)), value) in (0, -1)
        assert one(spark, quality.status(quality.flags(F.col("c0"), F.lit("h"))), value) == "flagged"


def test_failure_order(spark):
    f = lambda url, flags: spark.createDataFrame([(url, flags)], "u string, f array<string>").select(quality.failure_kind(F.col("u"), F.lit(True), F.col("f")).alias("k")).first().k
    assert f("https://h.org/post/a", []) == "clean"
    assert f("https://h.org/", ["pdf-rendered"]) == "clean"
    assert f("https://h.org/post/a", ["short-body", "login-wall-keyword"]) == "upstream-paywall"
    assert f("https://www.wsj.com/post/a", []) == "upstream-paywall"
    assert f("https://h.org/search?q=1", ["short-body"]) == "intentional-stub-app-only"
    assert f("https://h.org/post/a", ["x-not-found", "intentional-stub"]) == "upstream-deleted"
    assert f("nope", []) == "host-malformed"


def test_markdown():
    page = "<html><head><title>t</title></head><nav>n</nav><h1>T</h1><p>a <b>b</b><p>c<ul><li>x<li>y</ul><pre><code class='language-py'>k = 1\n</code></pre><table><tr><th>h<td>i</tr><tr><td>1|2</td></tr></table><img data-src='/r.png' src='data:x'>"
    md = M.to_markdown(page)
    assert md.startswith("# T\n\na **b**\n\nc")
    assert "- x\n- y" in md and "```py\nk = 1" in md and "| h | i |\n| --- | --- |\n| 1\\|2 |  |" in md and "![](/r.png)" in md and "n\n" not in md.split("# T")[0]


def test_cleanups_settle():
    text = "# A\n---\n# A and more\n\n# B\n\n## C\n## C\n[\n\nlink\n](http://x)\n[](y)\n- \n![:smile:](https://h/emoji/s.png)\n## **bold**\n```\n# kept\n[](y)\n```\nShare\n"
    once, applied = M.cleaned(text)
    assert M.cleaned(once)[0] == once and "one-h1" in applied
    assert once.startswith("# A and more\n---\n## B\n\n## C\n[link](http://x)\n")
    assert ":smile:" in once and "## bold" in once and "# kept\n[](y)" in once and "Share" not in once and "- " not in once


def test_link_rows_get_dots_between_links():
    row = "".join(f"[Category {k}](https://h.org/category/{k})" for k in range(6))
    assert M.split_link_rows(row) == row.replace(")[", ") · [")
    assert M.split_link_rows("[a](b)[c](d)") == "[a](b)[c](d)"  # a short row


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# T\n---\na\n\nSubscribe\n\nb\n分享\n```\nShare\n```\n", "# T\n---\na\n\nb\n```\nShare\n```\n"),
        ("Share\n---\nEmail\nPrint\nReddit\n", "Share\n---\nEmail\nPrint\nReddit\n"),
        ("Share\nno preamble\n", "Share\nno preamble\n"),
    ],
)
def test_share_lines(text, want):
    assert M.share_lines(text) == want


def test_avatars_tags_and_brackets():
    assert M.strip_avatars("x [![me](https://h/m.png)](/users/me) y [Name](/u/name/) z [long](/a/b/c)") == "x  y  z [long](/a/b/c)"
    assert M.tag_lines("text\n\n[a](/tag/a)[b](/tag/b)\n") == "text\n"
    assert M.tag_lines("[a](/tag/a)[b](/tag/b)\n" + "x\n" * 9) == "[a](/tag/a)[b](/tag/b)\n" + "x\n" * 9
    assert M.unescape_brackets(r"[\[profile\_data\]](u)") == "[[profile_data]](u)"
    assert M.cleaned("![a](../i.png) ![b](//c/d.png) ![e](local.png)", "https://h.org/x/y/z")[0] == "![a](https://h.org/x/i.png) ![b](https://c/d.png) ![e](local.png)"


def test_structural_rules():
    text = "a **b**c\nd**e** f\n`**x**y`\n```\n**x**y\n```\n**two\nlines** ok\n[\n\nx\n\n](http://u)\n:a\\_b:\n\\!\\[\n## \n****\n\n\nend"
    got = {(rule, line) for rule, line, _ in M.structural_issues(text)}
    assert got == {("bold-glued", 1), ("bold-glued", 2), ("multi-line-link", 9), ("escaped-emoji", 14), ("escaped-image", 15), ("empty-heading", 16), ("asterisk-run", 17), ("blank-run", 17)}
    assert M.structural_issues("") == []


def test_bold_spaces():
    assert M.space_bold("**GTC**Powering a**b** `x**y**z` **c\nd**e") == "**GTC** Powering a **b** `x**y**z` **c\nd** e"


def test_pdf_and_threads(spark):
    raw = "  Title of it\n Authors\n\nAbstract\nF LUX wor-\nld.\n12\n\nSpeed\n\nModel\n\nThis is a block of text that is long enough and ends in a point.\nPreprint. Under review.\narXiv:2401.01234v1 [cs] x\nall rights reserved by no one."
    assert one(spark, P.pdf_text(F.col("c0")), raw) == "Abstract\nFLUX wor-ld.\n\nThis is a block of text that is long enough and ends in a point.\nall rights reserved by no one."
    title = P.title_of_pdf(F.col("c0"))
    assert one(spark, title, "arXiv:1\n2024-01-02\nBeyond the buzz:\n A  pragmatic take\nx") == "Beyond the buzz: A pragmatic take" and one(spark, title, "x") is None
    assert M.thread([(2, "b", "two", 1), (1, "a", "one", None)]) == "**#1 a**\n\none\n\n> **#2 b**\n> \n> two"


def test_links_resolved(spark):
    raw = "---\na: b\n---\n\n# Head\n\nSee [[A b|shown]] [[C]] [[D|]].\n```\n[[C]]\n```\n[[C]]"
    urls = F.create_map(F.lit("C"), F.lit("http://c"))
    c = F.col("c0")
    assert one(spark, T.prepared(c, urls), raw) == "---\na: b\n---\nSee [shown](wiki-unresolved:A%20b) [C](http://c) [[D|]].\n```\n[[C]]\n```\n[C](http://c)"
    assert "See shown" in one(spark, T.prepared(c, urls, "plain"), raw)
    with pytest.raises(Exception, match="unresolved link"):
        one(spark, T.prepared(c, urls, "fail"), raw)
    assert [(x.line, x.target) for x in one(spark, T.link_places(c), raw)] == [(7, "A b"), (7, "C"), (7, "D"), (11, "C")]


def test_largest_source(spark):
    assert one(spark, M.largest_source(F.col("c0")), "a.png 100w, b.png 300w, c.png 2x") == "b.png"
