"""Links by a join against a loop over lines, with hot slugs, and against the form that takes a map."""

import re
from collections import Counter
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.operators import links


def brute(raw, urls):
    m = re.match(r"---\r?\n[\s\S]*?\r?\n---\r?\n", raw)
    head, text = (m[0], raw[m.end() :]) if m else ("", raw)
    if re.match(r"\s*#\s+\S", text):
        text = re.sub(r"\A\s*#[^\n]*(\n\s*(?=\S|\Z)|\n?\Z)", "", text)
    out, open_ = [], False
    for line in text.split("\n"):
        if line.startswith("```"):
            open_ = not open_
        elif not open_:
            line = re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: f"[{(m[2] or m[1]).strip()}]({urls.get(m[1].strip()) or 'wiki-unresolved:' + quote(m[1].strip())})", line)
        out.append(line)
    return head + "\n".join(out)


@pytest.mark.parametrize("hot", [1_000, 2])
def test_joined_links_equal_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(links, "HOT_LINKS", hot)
    urls = {"a": "https://w/a", "b c": "https://w/b", "ü": "https://w/u", "": "https://w/none"}
    raws = ["# T\n\nsee [[a]] and [[b c|B]] [[x y|lost]]", "[[a]]\n```\n[[a]]\n```\n[[ ü ]] [[]] [[a|]] [[a\nb]] [[a]", "---\nk: [[a]]\n---\n# H\n[[a]] [[a]] [[a]]", "", "none", "```\n[[a]]", "[[[a]]] [[a|x|y]]"]
    rows = [(k, r) for k, r in enumerate(raws * 3)] + [(0, raws[0]), (0, raws[1]), (99, None)]
    table = spark.createDataFrame([(s, u, 1) for s, u in urls.items()] + [("a", "https://w/z", 1), (None, "x", 1)], "slug string, url string, n int")
    pages = spark.createDataFrame(rows, "key int, raw string")
    got = Counter(map(tuple, links.prepared(pages, table).collect()))
    assert got == Counter((k, None if r is None else brute(r, urls)) for k, r in rows)
    as_map = F.create_map(*(F.lit(x) for p in urls.items() for x in p))
    assert Counter(map(tuple, pages.select("key", T.prepared(F.col("raw"), as_map)).collect())) == got


def test_missing_links(spark):
    pages = spark.createDataFrame([(1, "see [[x|that]]")], "key int, raw string")
    none = spark.createDataFrame([], "slug string, url string")
    assert links.prepared(pages, none, "plain").first().text == "see that"
    with pytest.raises(Exception, match="unresolved link: x"):
        links.prepared(pages, none, "fail").collect()
