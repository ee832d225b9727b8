"""Nested threads of any depth, and commits of several tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wikilake.operators import threads
from wikilake.sources.writers import Versions, replace


def flat(node, path, out):
    out.append((path, len(path) - 1, node.get("author"), node.get("body")))
    for k, x in enumerate(node["replies"] if isinstance(node.get("replies"), list) else []):
        if isinstance(x, dict):
            flat(x, [*path, k], out)
    return out


def test_threads_of_any_depth(spark):
    rng = random.Random(5)

    def grow(depth):
        return {"author": rng.choice(["ann", "bob"]), "body": rng.choice(["x\n\ny", "ü \"q\"", ""]), "replies": [grow(depth - 1) for _ in range(rng.randrange(0, 3))] if depth else rng.choice(["", None, [], {}])}

    deep = {"body": "end"}
    for k in range(30):
        deep = {"body": str(k), "replies": [1, deep]}
    trees = {1: grow(4), 2: deep, 3: {"body": None, "score": 3}}
    rows = [(k, json.dumps(v)) for k, v in trees.items()] + [(4, "no json"), (5, None), (6, "[]"), (7, json.dumps([trees[3], 2, {"author": "c"}])), (8, '"text"')]
    got = threads.walked(spark.createDataFrame(rows, "key int, json string"))
    want = [(k, *r) for k, v in trees.items() for r in flat(v, [0], [])] + [(7, [0], 0, None, None), (7, [2], 0, "c", None)]
    assert sorted(map(str, ((r.key, r.path, r.depth, r.author, r.body) for r in got.collect()))) == sorted(map(str, want))
    assert threads.walked(spark.createDataFrame([], "key int, json string")).count() == 0


def test_a_golden_thread(spark):
    tree = {"author": "ann", "score": 5, "body": "post", "replies": [{"author": "bob", "score": "2", "body": "one\n\ntwo", "replies": [{"body": "deep"}]}, {"author": "cy", "score": 1, "body": "last"}]}
    [got] = threads.rendered(threads.walked(spark.createDataFrame([(1, json.dumps(tree))], "key int, json string"))).collect()
    assert got.posts == 4
    assert got.markdown == "## u/ann\n\n> score 5\n\npost\n\n> **u/bob** · score 2\n>\n> one\n>\n> two\n\n> > **u/[deleted]** · score ?\n> >\n> > deep\n\n> **u/cy** · score 1\n>\n> last"


def test_commits_of_several_tables(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    row = lambda *x: spark.createDataFrame([(k,) for k in x], "k int")
    assert v.folders() == {} and v.commit({"a": row(1), "b": row(10)}) == 1
    state = lambda n=None: [sorted(r.k for r in v.read(t, n).collect()) for t in ("a", "b")]
    boom = row(2).withColumn("k", F.raise_error(F.lit("half-way")).cast("int"))
    with pytest.raises(Exception, match="half-way"):
        v.commit({"a": row(2), "b": boom})  # a is written, b fails: readers see the old state of both
    assert state() == [[1], [10]] and v.numbers() == [1]
    assert v.commit({"b": row(20, 21)}) == 2 and state() == [[1], [20, 21]] and state(1) == [[1], [10]]
    assert v.roll_back(1) == 3 and state() == [[1], [10]]
    late = Versions(spark, str(tmp_path / "store"))
    late.numbers = lambda: [2]  # it has not seen the last commit
    with pytest.raises(RuntimeError, match="taken"):
        late.commit({"a": row(5)})
    assert state() == [[1], [10]]
    v.prune(1)
    assert v.numbers() == [3] and state() == [[1], [10]] and len(list((tmp_path / "store" / "b").iterdir())) == 1


def test_replace_keeps_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        replace(spark.range(k + 1), path)
        assert spark.read.parquet(path).count() == k + 1
    assert spark.read.parquet(f"{path}.bak").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.bak"]
