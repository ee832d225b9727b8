"""Queries over pipeline state, revisions, ledgers, backups, and the relational operators that no other query has."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import urls as U
from wikilake.operators import dedupe, revisions, state
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()
_B, _R = A.with_(A.BOOKMARKS), A.with_(A.REVISIONS)


@query(_B + "SELECT norm_url, arg_min(bookmark_id, concat('p/', bookmark_id)) AS slug, min(concat('p/', bookmark_id)) AS repo_path, count(*) AS n FROM bookmarks GROUP BY norm_url")
def sources_indexed(spark, d):
    pages = A.bookmarks(spark, d).select(F.col("link").alias("source_url"), F.col("bookmark_id").alias("slug"), F.concat(F.lit("p/"), F.col("bookmark_id").cast("string")).alias("repo_path"))
    return state.build_index(pages)


@query(_B + "SELECT DISTINCT norm_url FROM bookmarks UNION SELECT concat('https://share.google/?link=https%3A%2F%2Fh.org%2F', bookmark_id) FROM bookmarks UNION SELECT concat('https://h.org/', bookmark_id) FROM bookmarks")
def urls_ingested(spark, d):
    b = A.bookmarks(spark, d)
    shared = b.select(F.concat(F.lit("https://share.google/?link=https%3A%2F%2Fh.org%2F"), F.col("bookmark_id").cast("string")).alias("norm_url"))
    return state.ingested_urls(b.select("norm_url").union(shared))


@query("SELECT max(ts) > TIMESTAMP '2000-01-01' AS rebuild, count(*) FILTER (WHERE event_id % 3 = 0) AS n_newer FROM events")
def index_rebuild(spark, d):
    built = F.lit("2000-01-01").cast("timestamp_ntz")
    files = A.table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("ts")).otherwise(F.lit("1999-01-01").cast("timestamp_ntz")).alias("modified"))
    return state.needs_rebuild(files, built)


@query("SELECT identifier, kind, url, slug FROM (SELECT concat('raindrop:', page_id) AS identifier, 'id' AS kind, url, concat('s-', page_id) AS slug FROM pages UNION ALL SELECT concat('s-', page_id), 'slug', CASE WHEN page_id % 2 = 0 THEN url END, concat('s-', page_id) FROM pages UNION ALL SELECT concat('https://h.org/', page_id), 'url', concat('https://h.org/', page_id), NULL FROM pages)")
def identifiers_resolved(spark, d):
    p = A.table(spark, d, "pages")
    i = F.col("page_id").cast("string")
    slug = F.concat(F.lit("s-"), i)
    asked = p.select(F.explode(F.array(F.concat(F.lit("raindrop:"), i), slug, F.concat(F.lit("https://h.org/"), i))).alias("identifier"))
    marks = p.select(F.col("page_id").alias("bookmark_id"), F.col("url").alias("link"), slug.alias("slug"))
    return state.resolved_identifiers(asked, marks, marks.where("bookmark_id % 2 = 0").select("slug", "link"))


@query("SELECT target, branch, slug, skip_key FROM (SELECT concat('s-', c_custkey) AS target, CASE c_custkey % 3 WHEN 0 THEN 'source-and-raw' WHEN 1 THEN 'raw-only' ELSE 'neither' END AS branch, concat('s-', c_custkey) AS slug, CASE WHEN c_custkey % 3 < 2 THEN concat('https://h.org/', c_custkey) ELSE concat('s-', c_custkey) END AS skip_key FROM customer UNION ALL SELECT concat('HTTPS://h.org/', c_custkey), CASE c_custkey % 3 WHEN 0 THEN 'source-and-raw' WHEN 1 THEN 'raw-only' ELSE 'neither' END, CASE WHEN c_custkey % 3 < 2 THEN concat('s-', c_custkey) END, concat('HTTPS://h.org/', c_custkey) FROM customer)")
def forget_plans(spark, d):
    i = F.col("c_custkey").cast("string")
    c = A.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("s-"), i).alias("slug"), F.concat(F.lit("https://h.org/"), i).alias("url"))
    targets = c.select(F.explode(F.array("slug", F.concat(F.lit("HTTPS://h.org/"), "c_custkey"))).alias("target"))
    return state.forget_plan(targets, c.where("c_custkey % 3 < 2").select("slug", "url"), c.where("c_custkey % 3 = 0").select("slug"))


_HOSTS = "CASE page_id % 3 WHEN 0 THEN 'https://a.org/wiki/' WHEN 1 THEN 'https://b.org/' ELSE 'https://c.org/' END"


@query(f"SELECT concat('/x', page_id // 6) AS path, count(*) AS n FROM pages WHERE page_id % 3 < 2 GROUP BY page_id // 6 HAVING count(DISTINCT {_HOSTS}) = 2")
def mirrors(spark, d):
    k = F.col("page_id")
    host = F.when(k % 3 == 0, "https://a.org/wiki/").when(k % 3 == 1, "https://b.org/").otherwise("https://c.org/")
    return dedupe.mirrored_paths(A.table(spark, d, "pages").select(F.concat(host, F.lit("X"), F.floor(k / 6).cast("string")).alias("link")), ("a.org", "b.org"))


@query("SELECT DISTINCT concat('a long title ', page_id // 4) AS key FROM pages WHERE page_id // 4 IN (SELECT page_id // 4 FROM pages WHERE page_id % 4 = 0) AND page_id // 4 IN (SELECT page_id // 4 FROM pages WHERE page_id % 4 = 1) AND page_id // 4 % 3 > 0")
def short_links(spark, d):
    k = F.col("page_id")
    group = F.floor(k / 4)
    link = F.when((k % 4 == 0) & (group % 3 > 0), "https://sho.rt/x").when(k % 4 == 1, "https://canonical.org/y").otherwise("https://other.org/z")
    rows = A.table(spark, d, "pages").select(F.concat(F.lit("A  long [Title] "), group.cast("string")).alias("title"), link.alias("link"))
    return dedupe.short_links(rows, "sho.rt", "canonical.org")


@query(_R + "SELECT slug, CAST(max(rev) + 1 AS INTEGER) AS next_rev FROM revisions GROUP BY slug")
def next_revisions(spark, d):
    return revisions.next_rev(A.revisions(spark, d))


@query(_R + "SELECT slug, rev, 'log' AS origin FROM revisions WHERE slug % 2 = 0 UNION ALL SELECT DISTINCT slug, 1, 'record' FROM revisions WHERE slug % 2 = 1")
def revisions_backfilled(spark, d):
    r = A.revisions(spark, d).select("slug", "rev")
    log = r.where("slug % 2 = 0").withColumn("origin", F.lit("log"))
    return revisions.backfilled(log, r.select("slug", F.lit("record").alias("origin")).distinct())


@query(_R + "SELECT slug, spec, CASE spec WHEN 'rev3' THEN (CASE WHEN n >= 3 THEN 3 END) WHEN '2024-01-10' THEN seen ELSE n END AS rev FROM (SELECT slug, max(rev) AS n, max(rev) FILTER (WHERE CAST(fetched_at AS DATE) <= DATE '2024-01-10') AS seen FROM revisions GROUP BY slug), (SELECT unnest(['rev3', '2024-01-10', NULL]) AS spec)")
def revisions_resolved(spark, d):
    r = A.revisions(spark, d)
    asked = r.select("slug").distinct().select("slug", F.explode(F.array(F.lit("rev3"), F.lit("2024-01-10"), F.lit(None).cast("string"))).alias("spec"))
    return revisions.resolve_rev(r, asked)


@query(_R + "SELECT slug, rev, fetched_at, status, CASE WHEN b IS NULL THEN 'first' WHEN b = sha THEN 'same' ELSE 'changed' END AS change FROM (SELECT *, lag(sha) OVER (PARTITION BY slug ORDER BY rev) AS b FROM revisions)")
def revision_history(spark, d):
    return revisions.history(A.revisions(spark, d))


@query(
    """SELECT doc_id, CAST(length(text) + 8 AS INTEGER) AS d_chars, CAST(len(regexp_extract_all(text, '(?m)^#{1,6} ')) + 1 AS INTEGER) AS d_headings, CAST(len(regexp_extract_all(text, '(?m)^```')) AS INTEGER) AS d_fences FROM documents WHERE text IS NOT NULL"""
)
def structural_deltas(spark, d):
    new = F.concat(F.lit("## new\n"), "text", F.lit("\n"), "text")
    rows = A.table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("a"), new.alias("b"))
    return revisions.structural_delta(rows, "a", "b").select("doc_id", "d_chars", "d_headings", "d_fences")


@query("SELECT p_partkey, CASE WHEN p_size * 30 < 60 THEN concat(p_size * 30, ' days') WHEN p_size * 30 < 730 THEN concat(p_size, ' months') ELSE concat(CAST(round(p_size * 30 / 365.0) AS BIGINT), ' years') END AS age FROM part")
def ages(spark, d):
    return A.table(spark, d, "part").select("p_partkey", revisions.age_text(F.col("p_size") * 30).alias("age"))


@query(_R + "SELECT slug, rev, (max(rev) OVER (PARTITION BY slug)) - rev >= 5 AS body_pruned FROM revisions")
def revisions_pruned(spark, d):
    r = A.revisions(spark, d).select("slug", "rev")
    return revisions.mark_pruned(r, revisions.plan_gc(r, 5))


@query("SELECT concat('https://w.org', p, c_custkey) AS url, c_custkey AS slug FROM customer, (SELECT unnest(['/wiki/', '/docx/', '/doc/']) AS p) WHERE c_custkey % 4 > 0")
def mentions_mapped(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey").cast("string")).alias("token"))
    return revisions.mention_map(c, "https://w.org")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'error' WHEN doc_id % 3 = 0 THEN 'first-baseline' WHEN doc_id % 3 = 1 THEN 'no-drift' ELSE 'drift' END AS drift FROM documents")
def reconcile_drift(spark, d):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    old = F.when(F.col("doc_id") % 3 == 1, sha).when(F.col("doc_id") % 3 == 2, "x")
    return A.table(spark, d, "documents").select("doc_id", revisions.reconcile_heavy(old, sha).alias("drift"))


@query("SELECT l_orderkey AS slug, l_linenumber AS name FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.06) AND l_orderkey % 3 > 0")
def restore_plans(spark, d):
    li = A.table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "slug", "l_linenumber": "name"})
    dis = li.where("l_discount > 0.08").select("slug", "name", F.when(F.col("l_tax") > 0.06, "delete").otherwise("keep").alias("decision"))
    return revisions.restore_plan(li.select("slug", "name"), dis, li.where("slug % 3 = 0"))


@query("SELECT p_partkey AS slug, p_name AS name, 'delete' AS decision FROM part WHERE p_name LIKE '%r_d%' UNION ALL SELECT p_partkey, p_name, 'keep' FROM part WHERE p_name LIKE 'c%'")
def files_pruned(spark, d):
    files = A.table(spark, d, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"))
    return revisions.prune(files, "*r?d*").unionByName(revisions.prune(files, "c*", keep=True))


@query("SELECT l_orderkey AS slug, count(*) AS n_files, CAST(sum(l_linenumber * 10) AS BIGINT) AS bytes, string_agg(concat('images/', l_linenumber, '.png'), ',' ORDER BY concat('images/', l_linenumber, '.png')) AS names FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey")
def slug_listings(spark, d):
    n, s = F.col("l_linenumber"), F.lit
    name = F.when(n == 1, ".DS_Store").when(n == 2, "images/tmp.123").when(n == 3, "_index.json").otherwise(F.concat(s("images/"), n.cast("string"), s(".png")))
    files = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), name.alias("name"), (n * 10).alias("bytes"))
    return revisions.slug_listing(files).select("slug", "n_files", F.col("bytes").cast("long").alias("bytes"), F.array_join("names", ",").alias("names"))


@query("SELECT count(*) AS n, count(DISTINCT slug) AS slugs FROM (SELECT c_custkey AS slug FROM customer LIMIT 5)")
def sample_verified(spark, d):
    """Five rows, drawn by a hash: which ones is for the hash to say."""
    got = revisions.verify_sample(A.table(spark, d, "customer").select(F.col("c_custkey").alias("slug")))
    return got.agg(F.count("*").alias("n"), F.count_distinct("slug").alias("slugs"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('https://h.org/', page_id, '-800.png') WHEN 1 THEN 'b2.png' ELSE 'last.png' END AS best FROM pages")
def srcset_picked(spark, d):
    from wikilake.functions import markdown as M

    k, s = F.col("page_id") % 3, F.lit
    own = F.concat(s("a.png 100w, https://h.org/"), F.col("page_id").cast("string"), s("-800.png 800w, c.png 400w"))
    return A.table(spark, d, "pages").select("page_id", M.largest_source(F.when(k == 0, own).when(k == 1, "b1.png 1x, b2.png 2.5x").otherwise("first.png, last.png")).alias("best"))


@query("SELECT page_id, concat('2024-05-06-page-', page_id) AS slug, concat('raindrop-', page_id) AS without FROM pages")
def slugs_derived(spark, d):
    i = F.col("page_id").cast("string")
    day = F.to_date(F.lit("2024-05-06"))
    return A.table(spark, d, "pages").select("page_id", U.derive_slug(F.concat(F.lit("Page! "), i), day, F.col("page_id")).alias("slug"), U.derive_slug(F.lit("?!"), day, F.col("page_id")).alias("without"))


@query(_R + "SELECT slug, count(*) FILTER (WHERE sha = 'click') AS click, count(*) FILTER (WHERE sha = 'purchase') AS purchase, count(*) FILTER (WHERE sha = 'view') AS view FROM revisions GROUP BY slug")
def revisions_pivot(spark, d):
    counts = A.revisions(spark, d).groupBy("slug").pivot("sha", ["click", "purchase", "view"]).agg(F.count("slug"))
    return counts.fillna(0, ["click", "purchase", "view"])


@query("SELECT o_custkey AS key FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def keys_except(spark, d):
    o = A.table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key")).exceptAll(o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")))


@query("SELECT o_custkey AS key FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def keys_intersect(spark, d):
    o = A.table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key")).intersect(o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def orders_page(spark, d):
    return A.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
