"""Queries over whole tables and whole texts, where the older query of the same name takes a part."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest

from wikilake.plans import catalog

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "table", "key"), [("url_unwrap_all", "pages", "page_id"), ("image_urls_resolved_all", "pages", "page_id"), ("reconcile_skew_all", "events", "user_id")])
def test_all_rows(spark, name, table, key):
    con = duckdb.connect()
    for f in glob.glob(f"{BIG}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(catalog.SQL[name]).fetchall()
    names = [c[0] for c in con.sql(catalog.SQL[name]).description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, BIG).select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} == {r[0] for r in con.sql(f"select distinct {key} from {table}").fetchall()}


FOLDER = "/root/testdata/sf0.001"


def _outside(text):
    kept, fenced = [], False
    for line in re.split(r"\r?\n", text):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced:
            kept.append(line)
    return kept


def _section(text, name):
    rows = re.split(r"\r?\n", text)
    begin = next(k for k, x in enumerate(rows) if x.rstrip(" ") == f"## {name}") + 1
    end = next((k for k in range(begin, len(rows)) if re.match("##? ", rows[k])), len(rows))
    return rows[begin:end]


def _trim(rows):
    return re.sub(r"\A[ \t-\r]+|[ \t-\r]+\Z", "", "\n".join(rows))


@pytest.fixture(scope="module")
def documents():
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    docs["text"] = docs.text.fillna("")
    return list(docs.itertuples())


def _rows(spark, name, key):
    return {r[key]: r for r in catalog.QUERIES[name](spark, FOLDER).collect()}


def test_fences_and_sections_of_whole_texts(spark, documents):
    strip, links, parts, counts = (_rows(spark, f"{n}_whole", "doc_id") for n in ("fence_strip", "wikilinks_extract", "section_extract", "md_features"))
    assert len(strip) == len(links) == len(parts) == len(counts) == len(documents)
    for d in documents:
        i, t = d.doc_id, d.text
        a = f"[[a {i % 7}]]"
        body = f"# T\n{a}\n{t}\n```\n[[hidden]]\n# hidden\n{t}\n" + ("" if i % 5 == 4 else "```\n") + f"{t}\n## Observations\n- [[b|see]]\n{t}\n- {a}\n## End\n{t}\n![i](x.png) ![j](http://h/y.png)"
        out, own = _outside(body), _section(body, "Observations")
        assert strip[i].text == "\n".join(out)
        assert links[i].links == ",".join(dict.fromkeys(x.strip(" ") for x in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", "\n".join(out))))
        assert (parts[i].section, parts[i].bullets, parts[i].excerpt) == (_trim(own), sum(x.startswith("- ") for x in re.split(r"\r?\n", _trim(own))), "## Observations\n" + _trim(own))
        c, n = counts[i], lambda rule: sum(bool(re.search(rule, x)) for x in out)  # noqa: B023
        assert (c.h1, c.h2, c.h3, c.empty_headings) == (n("^# "), n("^## "), n("^### "), n(r"^#{1,6}\s*$"))
        assert (c.fences, c.body_chars, c.unbalanced_bold) == (sum(x.startswith("```") for x in re.split(r"\r?\n", body)), len(body.strip(" ")), sum(x.count("**") % 2 for x in out))


def test_wiki_pages_of_whole_texts(spark, documents):
    bodies = {f"page {d.doc_id}": f"# page {d.doc_id}\n{d.text}\nSee [[page {d.doc_id % 10}]] and [[page 3|three]].\n## Observations\n- seen {d.lang}\n{d.text}" for d in documents}
    renamed, merged, headed, parts = (_rows(spark, f"{n}_whole", "slug") for n in ("rename_rewrite", "merge_docs", "comparison_heading", "page_parts"))
    to = lambda b, new: b.replace("[[page 3]]", f"[[{new}]]").replace("[[page 3|", f"[[{new}|")
    bullets = "\n".join(x for x in re.split(r"\r?\n", _trim(_section(bodies["page 3"], "Observations"))) if x.startswith("- "))
    for slug, b in bodies.items():
        new = to(b.replace("# page 3\n", "# p3\n", 1) if slug == "page 3" else b, "p3")
        assert renamed["p3" if slug == "page 3" else slug].body == new
        more = f"\n<!-- merged from page 3 -->\n{bullets}\n<!-- synthesis: stale -->\n" if slug == "page 5" else ""
        assert slug == "page 3" or merged[slug].body == to(b, "page 5") + more
        assert headed[slug].body == b.rstrip(" ") + "\n\n## Comparison\n"
        line = next(x for x in re.split(r"\r?\n", b) if x.strip(" ") and not x.startswith("#"))
        bullet = next(x for x in _section(b, "Observations") if x.startswith("- "))
        assert (parts[slug].title, parts[slug].paragraph, parts[slug].first_observation) == (slug, line if len(line) <= 137 else line[:137] + "...", bullet[2:])
    assert "page 3" not in merged and len(merged) == len(bodies) - 1


def test_tags_around_whole_texts(spark, documents):
    got = _rows(spark, "tag_markup_whole", "doc_id")
    for d in documents:
        t = d.text
        first = re.sub(r"\A[ \t-\r]+", "", t)
        assert got[d.doc_id].text == f"{t}> {first}" + re.sub(r"[ \t-\r]+\Z", "", t) + f"\n![]({d.source}) $x$ {t}"
