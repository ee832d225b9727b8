"""Joins, checks and rewrites on hand-made tables."""

import random

import pytest

from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.operators import audit, curation, graph, lint, revisions, state
from wikilake.sources import readers, writers


def test_refs_promote(spark):
    rows = [(f"s{k}", "hub") for k in range(4)] + [("s0", "spoke"), ("s1", "spoke"), ("hub", "hub"), ("s0", "hub")]
    got = {r.dst: r.refs for r in graph.count_refs(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {"hub": 4, "spoke": 2}


def test_empty_tables(spark):
    cites = spark.createDataFrame([], "src string, dst string")
    items = spark.createDataFrame([("a", "seen")], "key string, tier string")
    assert graph.count_refs(cites).count() == 0
    assert lint.orphans(items, cites, "key").count() == 1
    assert audit.similar_slugs(spark.createDataFrame([], "name string")).count() == 0


def test_similar_slugs_equal_all_pairs(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("abcd-") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"gpt-4", "gpt-5", "vllm", "vllms", "llama-index", "llama_index"}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(a, b):
        n = max(len(a), len(b))
        return n >= 4 and lev(a, b) * 5 <= n and not (a[-1].isdigit() and b[-1].isdigit() and a[:-1] == b[:-1])

    want = {(a, b) for a in names for b in names if a < b and near(a, b)}
    got = {(r.a, r.b) for r in audit.similar_slugs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want and want


def test_valid_prefix_and_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"slug":"a","rev":1}\n{"slug":"a","rev":2}\n{"slug":"a","re')
    (tmp_path / "b.jsonl").write_text('{"slug":"b","rev":1}\nnot json\n{"slug":"b","rev":3}\n')
    log = readers.jsonl(spark, str(tmp_path), readers.REVISION)
    assert sorted((r.slug, r.rev) for r in revisions.valid_prefix(log).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    kept, counts = revisions.repaired(log)
    assert kept.count() == 4 and tuple(counts.first()) == (4, 2)


def test_pages_and_registries(spark, tmp_path):
    for b in readers.BUCKETS:
        (tmp_path / b).mkdir()
    (tmp_path / "02_Entities" / "Hub.md").write_text("---\ntype: entity\n---\n# Hub\n[[X]]\n")
    (tmp_path / "02_Entities" / ".hidden.md").write_text("no")
    (tmp_path / "list.md").write_text("# L\n<!-- - old — gone -->\n- slug-a — why not\n- a b → c\n- s: pin-kind=clean # n\n- k — skip-reason=dup · text\n")
    page = readers.wiki_pages(spark, str(tmp_path)).collect()
    assert [(p.slug, p.bucket, p.links, p.frontmatter) for p in page] == [("Hub", "02_Entities", ["X"], {"type": "entity"})]
    path = str(tmp_path / "list.md")
    assert ("slug-a", "why not") in {tuple(r) for r in readers.fetch_decisions(spark, path).collect()}
    assert [tuple(r) for r in readers.aliases(spark, path).collect()] == [("a b", "c")]
    assert [tuple(r) for r in readers.kind_overrides(spark, path).collect()] == [("s", "clean")]
    assert [tuple(r) for r in readers.ingest_skips(spark, path).collect()] == [("k", "dup", "text")]


def test_csv_and_images(spark):
    df = spark.createDataFrame([('a,"x ""y"""\n,\nb,2',)], "t string")
    assert [tuple(r)[1:] for r in readers.csv_text(df, "t", "p string, q string").collect()] == [("a", 'x "y"'), ("b", "2")]
    kinds = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nxxxx"),), (bytearray(b"<svg></svg>"),), (bytearray(b"text"),)], "c binary")
    assert [r.k for r in kinds.select(readers.image_kind(F.col("c")).alias("k")).collect()] == ["png", "svg", None]


def test_running_limit_counts_only_fetches(spark):
    rows = spark.createDataFrame([(k, k % 2 == 0) for k in range(10)], "id int, f boolean")
    assert sorted(r.id for r in state.running_limit(rows, F.col("f"), 2, "id").collect()) == [0, 1, 2, 3]
    assert state.running_limit(rows, F.col("f"), 99, "id").count() == 10


def test_rename_merge_delete(spark):
    docs = spark.createDataFrame([("A", "# A\n## Observations\n- a1"), ("B", "# B\n[[A]] [[A|x]]"), ("C", "# C")], "slug string, body string")
    got = {r.slug: r.body for r in curation.renamed(docs, "A", "Z").collect()}
    assert got["Z"].startswith("# Z") and got["B"] == "# B\n[[Z]] [[Z|x]]"
    got = {r.slug: r.body for r in curation.merged(docs, "A", "C").collect()}
    assert set(got) == {"B", "C"} and "- a1" in got["C"] and "[[C|x]]" in got["B"]
    cites = docs.select(F.col("slug").alias("src"), F.explode(T.wikilinks(F.col("body"))).alias("dst"))
    assert sorted(r.slug for r in curation.deletable(docs, cites).collect()) == ["B", "C"]


def test_replace_keeps_the_old(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace(spark.range(3), path)
    writers.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(f"{path}.bak").count() == 3


def test_guards(spark):
    docs = spark.createDataFrame([("a", "x", "active"), ("b", "y", "seen")], "slug string, body string, tier string")
    with pytest.raises(ValueError, match="a is active, b only seen"):
        curation.merged(docs, "a", "b")
    assert [r.slug for r in curation.merged(docs, "a", "b", forced=True).collect()] == ["b"] and curation.merged(docs, "b", "a").count() == 1
    pages = spark.createDataFrame([("a", "x/a.md", "1"), ("a", "y/a.md", "2"), ("b", "b.md", "3")], "slug string, path string, content string")
    none = spark.createDataFrame([], "slug string, content_sha string")
    with pytest.raises(ValueError, match="slug collision: a is both x/a.md and y/a.md"):
        revisions.sync_changes(pages, none)
    assert revisions.sync_changes(pages.where("path <> 'y/a.md'"), none).count() == 2


def test_exponential_cells_round_exact_values(spark):
    """Ties go to the even digit, by the exact value of the number; infinities and what is no number are no ties."""
    from wikilake.functions import text as T

    given = ["1005000000", "1015000000", "-1.125e12", "1.135e12", "1.125e30", "999999999", "inf", "nan", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    got = [r.c for r in rows.select("k", T.format_cell(rows.x).alias("c")).orderBy("k").collect()]
    assert got == ["1.00e+09", "1.02e+09", "-1.12e+12", "1.14e+12", f"{1.125e30:.2e}", "999999999", "inf", "nan", "-"]


def test_sources_deletable_reads_all_orders(spark, tmp_path):
    from wikilake.plans import catalog

    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(9, 1), (10, 2)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r.slug for r in catalog.QUERIES["sources_deletable"](spark, str(tmp_path)).collect()] == [3]
