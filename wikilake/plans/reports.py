"""Queries of catalogues and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.operators import graph, report
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()


@query(A.with_(A.CITES, A.REFS, A.ITEMS) + "SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY coalesce(refs, 0) DESC, key) AS place, concat('- [[', key, ']] (', coalesce(refs, 0), ')') AS line FROM items LEFT JOIN refs ON key = dst")
def catalogue_entities(spark, d):
    rows = graph.with_refs(A.items(spark, d), A.cites(spark, d), "key")
    return report.entities_catalogue(rows.withColumnRenamed("key", "slug"))


@query("SELECT year(o_orderdate) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey DESC) AS place, concat('- [[', o_orderkey, ']] ', o_orderpriority) AS line FROM orders")
def catalogue_sources(spark, d):
    o = A.table(spark, d, "orders")
    return report.sources_catalogue(o.select(F.col("o_orderkey").alias("slug"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year")))


@query("SELECT p_brand AS bucket, CASE WHEN p_size <= 25 THEN 'seen' ELSE 'active' END AS tier, count(*) AS n FROM part GROUP BY ALL")
def catalogue_totals(spark, d):
    p = A.table(spark, d, "part")
    return report.totals(p.select(F.col("p_brand").alias("bucket"), F.when(F.col("p_size") <= 25, "seen").otherwise("active").alias("tier")))


@query("SELECT d.doc_id AS slug, CASE WHEN n_chars >= 500 THEN 'good' WHEN l.doc_id IS NOT NULL THEN 'decided' ELSE 'open' END AS part FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_report(spark, d):
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.when(F.col("n_chars") >= 500, "good").otherwise("flagged").alias("status"))
    return report.status_report(rows, A.table(spark, d, "labels").select(F.col("doc_id").alias("slug")))


@query(
    A.with_(A.BOOKMARKS)
    + """, c AS (SELECT bookmark_id AS id, norm_url, CASE WHEN length(title) >= 30 THEN 'good' ELSE 'flagged' END AS quality FROM bookmarks)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN norm_url IN (SELECT norm_url FROM c WHERE id % 6 = 0) THEN 'ingested' WHEN id % 7 = 0 THEN 'queued' WHEN norm_url IN (SELECT norm_url FROM c WHERE id % 11 = 0) THEN 'skipped'
    WHEN quality <> 'good' THEN 'quality' ELSE 'planned' END AS outcome FROM c) GROUP BY outcome"""
)
def ingest_plan_counters(spark, d):
    c = A.bookmarks(spark, d).select(F.col("bookmark_id").alias("id"), "norm_url", F.when(F.length("title") >= 30, "good").otherwise("flagged").alias("quality"))
    plan = report.ingest_plan(c, c.where("id % 6 = 0"), c.where("id % 7 = 0").select("id"), c.where("id % 11 = 0"))
    return plan.groupBy("outcome").agg(F.count("*").alias("n"))


@query(A.with_(A.CITES) + ", new AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT (SELECT count(*) FROM new) AS new_pages, (SELECT CAST(coalesce(sum(round(CAST(floor(o_totalprice) AS BIGINT) / 4.0)), 0) AS BIGINT) FROM new) AS tokens, (SELECT count(DISTINCT dst) FROM cites WHERE src IN (SELECT o_orderkey FROM new)) AS touched")
def ingest_preview(spark, d):
    pages = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").alias("created"), F.floor("o_totalprice").alias("chars"))
    return report.preview(pages, A.cites(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS place, concat('| ', p_partkey, ' | ', p_brand, ' | ', p_size, ' |') AS line FROM part ORDER BY p_partkey LIMIT 30")
def table_render(spark, d):
    return report.table_lines(A.table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")


@query("WITH b AS (SELECT conv_id, string_agg(concat('<', role, '> ', trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id) SELECT conv_id, content, sha256(content) AS sha FROM b")
def assemble_content(spark, d):
    c = A.table(spark, d, "conversations")
    return report.assembled(c.select("conv_id", F.col("turn").alias("place"), F.col("role").alias("tag"), "text"), "conv_id")


@query("SELECT doc_id, t || regexp_replace('> ' || regexp_replace(t, '^\\s+', '') || t, '\\s+$', '') || chr(10) || '![](' || source || ') $x$ ' || t AS text FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)")
def tag_markup_whole(spark, d):
    s, t = F.lit, F.coalesce("text", F.lit(""))
    raw = F.concat(t, s('<grid cols="2">\n<callout emoji="x">\n'), t, s('<text color="red">'), t, s('</text>\n</callout>\n<image token="'), "source", s('" width="1"/> <equation>x</equation> '), t, s("</grid>"))
    return A.table(spark, d, "documents").select("doc_id", report.rewrite_tags(raw).alias("text"))
