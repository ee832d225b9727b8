"""Names of several words against a regular expression of all of them, suffixes of hosts, and the table function of rules."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.operators import graph, lint, state


@pytest.mark.parametrize("rows", [100_000, 0])
def test_mentions_equal_an_alternation(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "SMALL_ROWS", rows)
    rng = random.Random(7)
    names = ["a", "a b", "a b c", "C++", ".NET", "大模型", "b-1", "b", "x (y)", "ab", "a  b", "é", "1"]
    texts = ["".join(rng.choice([*names, " ", " ", "-", "\n", "z", "é"]) for _ in range(rng.randrange(0, 25))) for _ in range(300)] + ["", None, "a b" * 3, "C++x C++ xC++"]
    pattern = re.compile(r"(?<![A-Za-z0-9])(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?![A-Za-z0-9])")
    got = graph.named_mentions(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(n,) for n in [*names, "a", ""]] + [(None,)], "name string"))
    want = Counter((k, m[1]) for k, t in enumerate(texts) for m in pattern.finditer(t or ""))
    assert Counter((r.text_id, r.name) for r in got.collect()) == want
    assert graph.named_mentions(spark.createDataFrame([(1, "a")], "text_id int, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_comparison_opportunities(spark):
    names = spark.createDataFrame([("Flash Attention",), ("Flash",), ("B200",), ("H",), ("Hopper",)], "name string")
    cu = "## Current understanding\n"
    topics = {
        "yes": f"{cu}Flash Attention vs B200, or Hopper.\n## Next\n",
        "nested": f"{cu}Flash Attention vs B200 only.",  # Flash is part of the longer name
        "linked": f"[[H]] and [[Hopper]]\n{cu}B200 differs from it",
        "short": f"{cu}H vs B200 and Hopper",  # too short for a bare name
        "table": f"{cu}Flash vs B200, Hopper\n ## Comparison ",
        "stub": f"{cu}_(stub — Flash vs B200, Hopper)",
        "calm": f"{cu}Flash, B200, Hopper",
        "elsewhere": f"Flash, Hopper\n{cu}B200 versus none\n# End\nFlash",
    }
    got = lint.comparison_opportunity(spark.createDataFrame(list(topics.items()), "path string, body string"), names)
    assert sorted((r.path, r.detail) for r in got.collect()) == [("linked", "3"), ("yes", "3")]


def test_host_suffixes(spark):
    rows = [(1, "a.b.org"), (1, "c.b.org"), (1, "a.b.org"), (2, "x.y"), (3, "a.org"), (3, "b.com"), (4, "b.org"), (4, "a.b.org"), (5, None), (6, "ab.org"), (6, "b.org")]
    got = state.host_suffixes(spark.createDataFrame(rows, "key int, host string")).collect()
    assert {(r.key, r.suffix, r.hosts) for r in got} == {(1, "b.org", 2), (2, "x.y", 1), (3, "", 2), (4, "b.org", 2), (6, "org", 2)}


def test_rules_as_a_table_function(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    frame = spark.createDataFrame([*((int(d.doc_id), d.text) for d in docs.itertuples()), (-1, "a \\![x\n##\nword**bold** d\n"), (-2, None)], "doc_id long, text string")
    want = Counter((int(d.doc_id), *i) for d in docs.itertuples() for i in M.structural_issues(d.text or "")) + Counter((-1, *i) for i in M.structural_issues("a \\![x\n##\nword**bold** d\n"))
    assert Counter(map(tuple, frame.lateralJoin(M.StructuralRules(F.col("text").outer())).select("doc_id", "rule", "line", "detail").collect())) == want
    spark.udtf.register("structural_rules", M.StructuralRules)
    frame.createOrReplaceTempView("rule_docs")
    assert Counter(map(tuple, spark.sql("SELECT d.doc_id, r.* FROM rule_docs d, LATERAL structural_rules(d.text) r").collect())) == want
    assert {r for _, r, *_ in want} >= {"empty-heading"}
