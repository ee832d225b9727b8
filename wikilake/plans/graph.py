"""Queries over the citation graph: references, checks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.operators import audit, graph, lint
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()
AS_OF = "2024-06-01"
TAGS = ["MACHINERY", "BUILDING", "AUTOMOBILE"]
_G = A.with_(A.CITES, A.REFS, A.ITEMS)
_ISSUE = "CAST(path AS VARCHAR) AS path, CAST(detail AS VARCHAR) AS detail"


@query(_G + "SELECT dst, CAST(refs AS BIGINT) AS refs, CASE WHEN refs >= 3 THEN 'active' ELSE 'seen' END AS tier FROM refs")
def refs_tier(spark, d):
    """Citation counts and tiers of all cited items."""
    return graph.count_refs(A.cites(spark, d)).withColumn("tier", graph.tier(F.col("refs")))


@query(_G + "SELECT dst, refs FROM refs ORDER BY refs DESC, dst LIMIT 10")
def refs_topk(spark, d):
    return graph.count_refs(A.cites(spark, d)).orderBy(F.desc("refs"), "dst").limit(10)


@query(
    A.with_(A.CITES)
    + """, topics AS (SELECT p_partkey AS topic FROM part WHERE p_size <= 10), sources AS (SELECT o_orderkey AS src FROM orders),
    both_ways AS (SELECT src AS source, dst AS topic FROM cites UNION SELECT dst, src FROM cites)
    SELECT topic, count(*) AS n_sources FROM both_ways WHERE source IN (SELECT src FROM sources) AND topic IN (SELECT topic FROM topics) GROUP BY topic"""
)
def source_counts_bidir(spark, d):
    topics = A.table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("topic"))
    sources = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"))
    return graph.source_counts(A.cites(spark, d), sources, topics)


@query(A.with_(A.CITES) + "SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS citing FROM cites GROUP BY dst")
def reverse_citations(spark, d):
    return graph.citations_of(A.cites(spark, d)).select("dst", F.array_join(F.transform("citing", lambda x: x.cast("string")), ",").alias("citing"))


@query(
    A.with_(A.CITES)
    + """, observed AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'O')
    SELECT c.dst, count(*) AS n_citing, count(*) FILTER (WHERE o.src IS NULL) AS n_missing FROM cites c LEFT JOIN observed o USING (src, dst) GROUP BY c.dst HAVING n_missing > 0"""
)
def observation_gaps(spark, d):
    observed = A.table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.observation_gaps(A.cites(spark, d), observed)


@query(
    _G
    + """SELECT key, tier, CAST(coalesce(refs, 0) AS BIGINT) AS refs, CASE WHEN tier = 'seen' AND coalesce(refs, 0) >= 3 THEN 'active' ELSE tier END AS new_tier
    FROM items LEFT JOIN refs ON key = dst WHERE (tier = 'seen' AND coalesce(refs, 0) >= 3) OR coalesce(refs, 0) <> 3"""
)
def plan_entity_updates(spark, d):
    rows = graph.with_refs(A.items(spark, d), A.cites(spark, d), "key").withColumn("stored_refs", F.lit(3)).withColumn("stored_tier", F.col("tier"))
    return graph.plan_updates(rows).select("key", "tier", "refs", "new_tier")


@query(_G + f"SELECT 'orphans' AS kind, 'warn' AS severity, {_ISSUE} FROM (SELECT key AS path, 'refs 0' AS detail FROM items WHERE key NOT IN (SELECT dst FROM refs))")
def lint_orphans(spark, d):
    return lint.orphans(A.items(spark, d), A.cites(spark, d), "key")


@query(_G + f"SELECT 'dead-wikilinks' AS kind, 'error' AS severity, {_ISSUE} FROM (SELECT src AS path, dst AS detail FROM cites WHERE dst NOT IN (SELECT key FROM items WHERE tier = 'active'))")
def lint_dead_links(spark, d):
    return lint.dead_links(A.cites(spark, d), A.items(spark, d).where("tier = 'active'"), "key")


_TIER = """SELECT 'tier-mismatch' AS kind, CASE WHEN tier = 'seen' THEN 'error' ELSE 'warn' END AS severity, CAST(key AS VARCHAR) AS path, concat(tier, ':', coalesce(refs, 0)) AS detail
  FROM items LEFT JOIN refs ON key = dst WHERE (tier = 'seen' AND coalesce(refs, 0) >= 3) OR (tier = 'active' AND coalesce(refs, 0) < 3)"""


@query(_G + _TIER)
def lint_tier_mismatch(spark, d):
    return lint.tier_mismatch(graph.with_refs(A.items(spark, d), A.cites(spark, d), "key"), "key")


@query(
    """WITH pages_ AS (SELECT doc_id AS path, ['type', 'created', CASE WHEN lang = 'en' THEN 'updated' END, CASE WHEN n_chars > 1000 THEN 'source_url' END] AS keys FROM documents),
    gaps AS (SELECT path, unnest(list_filter(['type', 'created', 'updated', 'source_url', 'tags'], lambda k: NOT list_contains(list_filter(keys, lambda x: x IS NOT NULL), k))) AS detail FROM pages_)
    SELECT 'frontmatter' AS kind, 'error' AS severity, CAST(path AS VARCHAR) AS path, detail FROM gaps"""
)
def lint_frontmatter(spark, d):
    keys = F.array_compact(F.array(F.lit("type"), F.lit("created"), F.when(F.col("lang") == "en", "updated"), F.when(F.col("n_chars") > 1000, "source_url")))
    return lint.missing_keys(A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("03_Sources").alias("bucket"), keys.alias("keys")))


@query(
    """WITH t AS (SELECT c_custkey AS path, list_filter([c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'DEBT' END], lambda x: x IS NOT NULL AND NOT list_contains(['MACHINERY', 'BUILDING', 'AUTOMOBILE'], x)) AS odd FROM customer)
    SELECT 'tag-vocabulary' AS kind, 'warn' AS severity, CAST(path AS VARCHAR) AS path, array_to_string(list_sort(list_distinct(odd)), ',') AS detail FROM t WHERE len(odd) > 0"""
)
def lint_tag_vocabulary(spark, d):
    tags = F.array_compact(F.array("c_mktsegment", F.when(F.col("c_acctbal") < 0, "DEBT")))
    return lint.unknown_tags(A.table(spark, d, "customer").select(F.col("c_custkey").alias("path"), tags.alias("tags")), TAGS)


@query(
    """SELECT 'raw-orphan' AS kind, CASE WHEN d.doc_id IS NULL THEN 'error' ELSE 'info' END AS severity, CAST(coalesce(l.doc_id, d.doc_id) AS VARCHAR) AS path,
    CASE WHEN d.doc_id IS NULL THEN 'no raw content' ELSE 'no source' END AS detail
    FROM (SELECT doc_id FROM labels WHERE quality = 1) l FULL JOIN (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'flagged' ELSE 'good' END AS q FROM documents WHERE doc_id % 3 > 0) d USING (doc_id)
    WHERE (l.doc_id IS NULL OR d.doc_id IS NULL) AND (l.doc_id IS NOT NULL OR d.q = 'good')"""
)
def raw_orphan_full_outer(spark, d):
    sources = A.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("slug"))
    raw = A.table(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("slug"), F.when(F.col("n_chars") < 500, "flagged").otherwise("good").alias("quality"))
    return lint.raw_orphans(sources, raw)


_NEWEST = ", newest AS (SELECT dst AS key, max(CAST(o_orderdate AS DATE)) AS newest, count(*) AS observations FROM cites JOIN orders ON src = o_orderkey GROUP BY dst)"
_SYNTH = ", synth AS (SELECT p_partkey AS key, CAST(DATE '1998-01-01' + CAST(p_size * 5 AS INTEGER) AS DATE) AS synthesised FROM part)"


def _stale(spark, d, as_of):
    dated = A.dated_cites(spark, d).groupBy(F.col("dst").alias("key")).agg(F.max("updated").alias("newest"), F.count("*").alias("observations"))
    synth = A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.date_add(F.to_date(F.lit("1998-01-01")), F.col("p_size") * 5).alias("synthesised"))
    return lint.stale_synthesis(synth.join(dated.select("key", "observations"), "key", "left").fillna(0, ["observations"]), dated.select("key", "newest"), as_of, "key")


@query(
    A.with_(A.CITES)
    + _NEWEST
    + _SYNTH
    + """SELECT 'stale-synthesis' AS kind, 'warn' AS severity, CAST(key AS VARCHAR) AS path, CASE WHEN newest - synthesised > 7 THEN concat('lag ', newest - synthesised) ELSE concat('age ', DATE '2024-06-01' - synthesised) END AS detail
    FROM synth LEFT JOIN newest USING (key) WHERE coalesce(newest - synthesised > 7, false) OR (DATE '2024-06-01' - synthesised > 30 AND coalesce(observations, 0) >= 3)"""
)
def stale_synthesis(spark, d):
    return _stale(spark, d, AS_OF)


@query(
    """WITH f AS (SELECT user_id AS key, max(CAST(ts AS DATE)) AS last FROM events GROUP BY user_id), s AS (SELECT user_id AS key, min(CAST(ts AS DATE)) - CAST(user_id % 40 AS INTEGER) AS reviewed FROM events GROUP BY user_id)
    SELECT 'stale-source-review' AS kind, 'warn' AS severity, CAST(key AS VARCHAR) AS path, CAST(last - CAST(reviewed AS DATE) AS VARCHAR) AS detail FROM s JOIN f USING (key) WHERE last - CAST(reviewed AS DATE) > 30"""
)
def stale_review(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("fetched"))
    reviewed = e.groupBy("key").agg(F.min("fetched").alias("first")).select("key", F.date_sub("first", (F.col("key") % 40).cast("int")).alias("reviewed"))
    return lint.stale_review(reviewed, e, "key")


@query(
    """WITH n AS (SELECT max(CAST(o_orderdate AS DATE)) AS newest, arg_max(o_orderkey, {'a': CAST(o_orderdate AS DATE), 'b': o_orderkey}) AS slug FROM orders)
    SELECT 'stale-top-synthesis' AS kind, 'warn' AS severity, 'root' AS path, CAST(slug AS VARCHAR) AS detail FROM n WHERE newest - DATE '1995-01-01' > 7"""
)
def stale_top(spark, d):
    topics = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.to_date("o_orderdate").alias("updated"))
    return lint.stale_top(spark.range(1).select(F.lit("root").alias("path"), F.to_date(F.lit("1995-01-01")).alias("updated")).drop("id").withColumnRenamed("updated", "updated"), topics)


@query(
    _G
    + f", issues AS (SELECT key FROM items WHERE key NOT IN (SELECT dst FROM refs) UNION ALL SELECT key FROM ({_TIER.replace('SELECT ', 'SELECT key, ', 1)}))"
    + "SELECT 'curation-needed' AS kind, 'info' AS severity, '.' AS path, CAST(count(*) AS VARCHAR) AS detail FROM issues HAVING count(*) >= 5"
)
def lint_curation_needed(spark, d):
    return lint.curation_needed(lint.run(lint_orphans(spark, d), lint_tier_mismatch(spark, d)))


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS name FROM part), v AS (SELECT name FROM w UNION SELECT DISTINCT lower(n_name) FROM nation),
    p AS (SELECT a.name AS a, b.name AS b, greatest(length(a.name), length(b.name)) AS ln FROM v a JOIN v b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 0.2 * greatest(length(a.name), length(b.name)) + 1e-9)
    SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM p WHERE ln >= 4 AND levenshtein(a, b) * 5 <= ln
      AND NOT (regexp_matches(a, '[0-9]$') AND regexp_matches(b, '[0-9]$') AND left(a, length(a) - 1) = left(b, length(b) - 1))"""
)
def slug_similarity(spark, d):
    words = A.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    return audit.similar_slugs(words.unionByName(A.table(spark, d, "nation").select(F.lower("n_name").alias("name"))))


@query(
    """WITH w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS name FROM part UNION ALL SELECT lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey), v AS (SELECT DISTINCT name FROM w), r AS (SELECT name, count(*) AS n FROM w GROUP BY name),
    p AS (SELECT a.name AS a, b.name AS b, greatest(length(a.name), length(b.name)) AS ln FROM v a JOIN v b ON a.name < b.name),
    d AS (SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM p WHERE ln >= 4 AND levenshtein(a, b) * 5 <= ln AND NOT (regexp_matches(a, '[0-9]$') AND regexp_matches(b, '[0-9]$') AND left(a, length(a) - 1) = left(b, length(b) - 1)))
    SELECT row_number() OVER (ORDER BY x.n + y.n DESC, a, b) AS place, a, b, distance, x.n + y.n AS refs FROM d JOIN r x ON x.name = a JOIN r y ON y.name = b"""
)
def duplicates_ranked(spark, d):
    """Like words of parts' names and names of customers' nations, the most frequent first."""
    nations = A.table(spark, d, "customer").join(F.broadcast(A.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    words = A.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).unionByName(nations.select(F.lower("n_name").alias("name")))
    return audit.ranked_duplicates(audit.similar_slugs(words), words.groupBy("name").agg(F.count("*").alias("refs")))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part UNION SELECT DISTINCT upper(p_name), regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') FROM part WHERE p_size < 5)
    SELECT name, next FROM (SELECT name, lead(name) OVER (PARTITION BY key ORDER BY name) AS next FROM n) WHERE next IS NOT NULL"""
)
def topic_collisions_lead(spark, d):
    p = A.table(spark, d, "part")
    return audit.collisions(p.select(F.col("p_name").alias("name")).unionByName(p.where("p_size < 5").select(F.upper("p_name").alias("name"))))


@query(
    """WITH tagged AS (SELECT s_suppkey AS slug, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS tag FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 > 0),
    use AS (SELECT tag, count(DISTINCT slug) AS n FROM tagged GROUP BY tag) SELECT slug FROM tagged JOIN use USING (tag) GROUP BY slug HAVING bool_and(n = 1)"""
)
def audit_tag_outliers(spark, d):
    s = A.table(spark, d, "supplier")
    tags = F.when(F.col("s_suppkey") % 7 == 0, F.array("s_name", F.col("s_nationkey").cast("string"))).otherwise(F.array("s_name"))
    return audit.tag_outliers(s.select(F.col("s_suppkey").alias("slug"), tags.alias("tags")))


@query(
    A.with_(A.CITES)
    + """, b AS (SELECT o_orderkey AS src, CASE WHEN o_orderpriority LIKE '1%' THEN '02_Entities' ELSE '01_Topics' END AS bucket FROM orders), k AS (SELECT dst, bucket FROM cites JOIN b USING (src))
    SELECT DISTINCT dst FROM k WHERE bucket = '01_Topics' AND dst NOT IN (SELECT dst FROM k WHERE bucket = '02_Entities')"""
)
def audit_topic_only_cited(spark, d):
    bucket = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.when(F.col("o_orderpriority").startswith("1"), "02_Entities").otherwise("01_Topics").alias("bucket"))
    return audit.topic_only(A.cites(spark, d), bucket)


@query("SELECT o_orderkey AS slug, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE DATE '2024-06-01' - CAST(o_orderdate AS DATE) > 9000")
def audit_age_stale(spark, d):
    return audit.age_stale(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.to_date("o_orderdate").alias("updated")), AS_OF, 9000)


@query(
    A.with_(A.CITES)
    + """, d AS (SELECT p_partkey AS dst, p_brand AS bucket, p_type AS path FROM part UNION ALL SELECT s_suppkey, 'supplier', 'zz' FROM supplier)
    SELECT dst AS slug, count(*) AS pages, arg_max(bucket, path) AS bucket FROM d GROUP BY dst HAVING count(*) > 1"""
)
def slug_collisions(spark, d):
    a = A.table(spark, d, "part").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("bucket"), F.col("p_type").alias("repo_path"))
    b = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.lit("supplier").alias("bucket"), F.lit("zz").alias("repo_path"))
    return graph.slug_collisions(a.unionByName(b))
