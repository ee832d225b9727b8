"""Readers, writers and small functions that no query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.operators import quality
from wikilake.sources import readers, writers


def test_records_and_their_status(spark, tmp_path):
    for host, slug, record in (("h.org", "a", {"origin": "x", "quality_status": "good", "images": [{"local": "i.png", "bytes": 3}]}), ("h.org", "b", {"quality_status": None}), ("k.org", "c", {"quality_status": "flagged"})):
        (tmp_path / host / slug).mkdir(parents=True)
        (tmp_path / host / slug / "source.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "h.org" / "phantom").mkdir()
    rows = readers.raw_records(spark, str(tmp_path))
    assert sorted((r.host, r.slug, r.quality_status) for r in rows.collect()) == [("h.org", "a", "good"), ("h.org", "b", None), ("k.org", "c", "flagged")]
    contents = spark.createDataFrame([("a", "flagged"), ("b", "good"), ("d", "good")], "slug string, live string")
    got = {r.slug: r.status for r in readers.stored_status(rows.select("slug", "quality_status"), contents).collect()}
    assert got == {"a": "good", "b": "good", "c": "failed", "d": "good"}


def test_an_index_that_is_broken_is_an_error(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"https://h/a": {"slug": "a", "repo_path": "p", "source_url": "https://h/A", "ingested_at": "2024-01-01"}}))
    bad.write_text('{"https://h/a": {"slug": ')
    assert [tuple(r) for r in readers.sources_index(spark, str(good)).collect()] == [("https://h/a", "a", "p", "https://h/A", "2024-01-01")]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.sources_index(spark, str(bad)).collect()


def test_residue(spark):
    files = [("a", "source.json"), ("a", "content.md"), ("b", "x.png"), ("b", "y.jpeg"), ("c", "content.md"), ("d", "source.json"), ("d", "content.md.tmp")]
    got = readers.residue(spark.createDataFrame(files, "dir string, name string")).collect()
    assert {tuple(r) for r in got} == {("b", "images-only"), ("c", "phantom"), ("d", "unfinished")}


def test_kinds_have_an_order(spark):
    kinds = [*quality.KINDS, "no kind"]
    got = spark.createDataFrame([(k,) for k in reversed(kinds)], "k string").orderBy(quality.kind_order(F.col("k"))).collect()
    assert [r.k for r in got] == ["no kind", *quality.KINDS]


def test_sinks_of_reports(spark, tmp_path):
    issues = spark.createDataFrame([("b", "warn", "p2", "x"), ("a", "error", "p1", "y"), ("a", "info", "p0", "z"), ("a", "warn", "p3", None)], "kind string, severity string, path string, detail string")
    assert [r.value.split()[:3] for r in writers.issues_text(issues).collect()] == [["error", "a", "p1:"], ["warn", "a", "p3:"], ["warn", "b", "p2:"], ["info", "a", "p0:"]]
    table = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert writers.markdown_table(table.orderBy("k")) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |" and writers.markdown_table(table.orderBy("k"), 1).count("\n") == 2
    for k in range(2):
        writers.append_jsonl(spark.range(k, k + 1), f"{tmp_path}/log")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/log").collect()) == [0, 1]


def test_diffs_spaces_and_images(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("same", "same"), (None, "new")], "a string, b string")
    assert [r.d for r in df.select(M.unified_diff(F.col("a"), F.col("b")).alias("d")).collect()] == ["--- \n+++ \n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c", "", "--- \n+++ \n@@ -1 +1 @@\n-\n+new"]
    assert [r.x for r in df.select(M.bold_spaced(F.concat(F.lit("**k**"), "b")).alias("x")).collect()] == ["**k** a\nx\nc", "**k** same", "**k** new"]
    run = M.resolve_images("https://h.org/a/b")
    assert run("![x](./i.png) ![y](/j.png) ![z](//c.org/k.png) ![w](https://d/l.png) ![v](m.png) <img class=q src='../n.png'>") == "![x](https://h.org/a/i.png) ![y](https://h.org/j.png) ![z](https://c.org/k.png) ![w](https://d/l.png) ![v](m.png) <img class=q src='https://h.org/n.png'>"
