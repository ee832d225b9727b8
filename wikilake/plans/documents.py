"""Queries over document quality, failure kinds, measures and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.operators import curation, graph, quality
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()


def _any(words, where):
    return "(" + " OR ".join(f"contains({where}, '{w}')" for w in words) + ")"


_SIZE = "length(t)"
_HEADINGS = "len(regexp_extract_all(t, '(?m)^#{1,6}\\s+\\S'))"
_REGION = f"(CASE WHEN length(t) < {quality.LOGIN_TEXT} THEN t ELSE left(t, {quality.LOGIN_HEAD}) END)"
_FLAGS = f"""trimmed AS (SELECT doc_id, lang, source, n_chars, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), flagged AS (SELECT doc_id, lang, source, n_chars, list_filter([
  CASE WHEN {_SIZE} < {quality.SHORT} THEN 'short-body' END,
  CASE WHEN {_SIZE} >= {quality.NO_HEADINGS} AND {_HEADINGS} = 0 THEN 'no-headings-in-body' END,
  CASE WHEN {_HEADINGS} < 3 AND {_any(quality.LOGIN, _REGION)} THEN 'login-wall-keyword' END,
  CASE WHEN {_SIZE} < {quality.LOADING_TEXT} AND {_any(quality.LOADING, 't')} THEN 'loading-skeleton' END], lambda x: x IS NOT NULL) AS flags FROM trimmed)"""


def _flagged(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.withColumn("flags", quality.flags(F.col("text"), F.col("source")))


@query(f"WITH {_FLAGS} SELECT doc_id, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) > 0 THEN 'flagged' ELSE 'good' END AS status FROM flagged")
def quality_flags(spark, d):
    rows = _flagged(spark, d)
    return rows.select("doc_id", F.array_join("flags", ",").alias("flags"), quality.status(F.col("flags")).alias("status"))


@query(f"WITH {_FLAGS} SELECT source, CASE WHEN len(flags) > 0 THEN 'flagged' ELSE 'good' END AS status, count(*) AS n FROM flagged GROUP BY ALL")
def quality_status_counts(spark, d):
    return _flagged(spark, d).groupBy("source", quality.status(F.col("flags")).alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_FLAGS} SELECT doc_id, CASE WHEN list_contains(flags, 'login-wall-keyword') THEN 'log in and fetch again' WHEN list_contains(flags, 'loading-skeleton') THEN 'fetch with a browser'
    WHEN list_contains(flags, 'short-body') THEN 'check the source; accept it if it is short' ELSE 'look at it by hand' END AS advice FROM flagged"""
)
def quality_remediation(spark, d):
    return _flagged(spark, d).select("doc_id", quality.remediation(F.col("flags")).alias("advice"))


@query(
    f"""WITH {_FLAGS}, f AS (SELECT doc_id, flags, doc_id % 5 = 0 AS missing, doc_id % 7 = 0 AS stub, doc_id % 23 = 0 AS pinned, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'lan' WHEN doc_id % 17 = 0 THEN 'pdf' WHEN doc_id % 2 = 0 THEN 'app' ELSE 'web' END AS kind_of FROM flagged)
    SELECT doc_id, CASE WHEN pinned THEN 'dead-link-accepted' WHEN kind_of = '' THEN 'host-malformed' WHEN kind_of = 'lan' THEN 'host-lan-only' WHEN kind_of = 'pdf' THEN 'upstream-not-html' WHEN missing THEN 'not-yet-fetched'
    WHEN stub AND list_contains(flags, 'loading-skeleton') THEN CASE WHEN kind_of = 'app' THEN 'intentional-stub-app-only' ELSE 'upstream-spa-no-content' END
    WHEN stub AND list_contains(flags, 'login-wall-keyword') THEN 'upstream-paywall' WHEN stub THEN 'upstream-fetch-failed' WHEN list_contains(flags, 'login-wall-keyword') THEN 'upstream-paywall'
    WHEN len(flags) > 0 AND kind_of = 'app' THEN 'intentional-stub-app-only' WHEN list_contains(flags, 'short-body') THEN 'content-too-short' WHEN list_contains(flags, 'loading-skeleton') THEN 'upstream-spa-no-content' ELSE 'clean' END AS kind FROM f"""
)
def failure_kind(spark, d):
    i = F.col("doc_id")
    url = (
        F.when(i % 11 == 0, "nowhere")
        .when(i % 13 == 0, "http://192.168.1.9/post/x")
        .when(i % 17 == 0, "https://h.example.org/a.PDF")
        .when(i % 2 == 0, "https://h.example.org/login/")
        .otherwise("https://h.example.org/post/x")
    )
    pinned = F.when(i % 23 == 0, "dead-link-accepted")
    flags = F.when(i % 7 == 0, F.array_append("flags", F.lit(quality.STUB))).otherwise(F.col("flags"))
    return _flagged(spark, d).select("doc_id", quality.failure_kind(url, i % 5 != 0, flags, pinned).alias("kind"))


@query(
    """SELECT doc_id, regression FROM (SELECT doc_id, n_chars, lag(n_chars) OVER w AS old, n_chars < 500 AND lag(n_chars) OVER w >= 500 AND n_chars < lag(n_chars) OVER w * 0.3 AS regression
    FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE old IS NOT NULL"""
)
def fetch_regression(spark, d):
    from pyspark.sql import Window

    old = F.lag("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = A.table(spark, d, "documents").withColumn("old", old).where("old is not null")
    return rows.select("doc_id", quality.is_regression(F.col("old"), F.col("old") < 500, F.col("n_chars"), F.col("n_chars") < 500).alias("regression"))


@query(
    """WITH names AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS name FROM part UNION SELECT 'the'),
    words AS (SELECT doc_id AS text_id, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9]+)', 1))) AS name FROM documents) SELECT text_id, name FROM words WHERE name IN (SELECT name FROM names)"""
)
def dictionary_match(spark, d):
    p = A.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).select(F.lower("name").alias("name"))
    names = p.unionByName(spark.range(1).select(F.lit("the").alias("name"))).distinct()
    return graph.mentions(A.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), names)


@query("SELECT lang AS kind, count(*) AS prompts, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(CAST(round(n_chars / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def prompt_measures(spark, d):
    return curation.measures(A.table(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("n_chars").alias("chars")))


@query("SELECT doc_id, round(t * 0.000003 + t * 0.0000045, 7) AS dollars FROM (SELECT doc_id, CAST(round(n_chars / 4.0) AS BIGINT) AS t FROM documents)")
def cost_estimate(spark, d):
    return A.table(spark, d, "documents").select("doc_id", curation.cost(curation.tokens(F.col("n_chars"))).alias("dollars"))


@query("SELECT c_custkey AS slug, CAST(round(c_acctbal) AS BIGINT) AS lag, row_number() OVER (ORDER BY round(c_acctbal) DESC, c_custkey) > 25 AS deferred FROM customer")
def stale_order_topn(spark, d):
    stale = A.table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.round("c_acctbal").cast("long").alias("lag"))
    return curation.stale_order(stale, 25)


@query(
    """SELECT o_orderkey, o_totalprice > 200000 OR CASE WHEN o_orderpriority LIKE '1%' THEN 3 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 1 END >= 2 AS dispatch FROM orders"""
)
def curation_dispatch(spark, d):
    confidence = F.when(F.col("o_orderpriority").startswith("1"), "High").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    return A.table(spark, d, "orders").select("o_orderkey", curation.should_dispatch(F.col("o_totalprice") > 200000, confidence, "medium").alias("dispatch"))


@query(
    """SELECT path, kind, state, line FROM (SELECT s_suppkey AS path, CAST(s_nationkey AS VARCHAR) AS kind, CASE WHEN s_acctbal > 0 THEN 'actionable' ELSE 'skipped' END AS state,
    CASE WHEN s_acctbal > 0 THEN concat('- [ ] ', s_nationkey, '-', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), ': `fix ', s_name, '`') END AS line FROM supplier)"""
)
def curation_proposals(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").cast("string").alias("kind"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("fix "), "s_name")).alias("command"))
    return curation.proposals(s).select("path", "kind", "state", "line")


@query(
    """WITH a AS (SELECT n_name AS variant, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey), i AS (SELECT n_name AS slug FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region WHERE r_regionkey > 1)
    SELECT variant, canonical FROM a WHERE variant IN (SELECT slug FROM i) AND canonical IN (SELECT slug FROM i)"""
)
def alias_merges(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    aliases = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("variant"), F.col("r_name").alias("canonical"))
    items = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("slug")).union(r.where("r_regionkey > 1").select("r_name"))
    return curation.alias_merges(aliases, items)


@query(
    """WITH i AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'seen' END AS tier FROM nation WHERE n_nationkey < 15),
    det AS (SELECT DISTINCT CASE WHEN n_name = 'FRANCE' THEN 'CHINA' ELSE n_name END AS name, n_nationkey FROM nation) SELECT n_nationkey, name, coalesce(tier, 'new') AS state FROM det LEFT JOIN i USING (name)"""
)
def detected_entities(spark, d):
    n = A.table(spark, d, "nation")
    items = n.where("n_nationkey < 15").select(F.col("n_name").alias("slug"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("seen").alias("tier"))
    aliases = spark.range(1).select(F.lit("FRANCE").alias("variant"), F.lit("CHINA").alias("canonical"))
    return curation.detected_entities(n.select("n_nationkey", F.col("n_name").alias("name")), aliases, items)


def wiki_whole(spark, d):
    """Pages of wiki with the whole text before and in the observations."""
    i, s, t = F.col("doc_id").cast("string"), F.lit, F.coalesce("text", F.lit(""))
    text = F.concat(s("# page "), i, s("\n"), t, s("\nSee [[page "), (F.col("doc_id") % 10).cast("string"), s("]] and [[page 3|three]].\n## Observations\n- seen "), "lang", s("\n"), t)
    return A.table(spark, d, "documents").select(F.concat(s("page "), i).alias("slug"), text.alias("body"))


@query()
def rename_rewrite_whole(spark, d):
    return curation.renamed(wiki_whole(spark, d), "page 3", "p3").select("slug", "changed", "body")


@query()
def merge_docs_whole(spark, d):
    return curation.merged(wiki_whole(spark, d), "page 3", "page 5").select("slug", "body")


_WIKI = "'# page ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || 'See [[page ' || doc_id % 10 || ']] and [[page 3|three]].' || chr(10) || '## Observations' || chr(10) || '- seen ' || lang || chr(10) || coalesce(text, '')"


@query(f"SELECT 'page ' || doc_id AS slug, regexp_replace({_WIKI}, '\\s+$', '') || chr(10) || chr(10) || '## Comparison' || chr(10) AS body FROM documents")
def comparison_heading_whole(spark, d):
    return wiki_whole(spark, d).withColumn("body", curation.with_heading(F.col("body"), "Comparison"))


@query(
    """WITH p AS (SELECT doc_id, lang, list_filter(string_split(coalesce(text, '') || chr(10) || 'See [[page ' || doc_id % 10 || ']] and [[page 3|three]].', chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))[1] AS line FROM documents)
    SELECT 'page ' || doc_id AS slug, 'seen ' || lang AS first_observation, 'page ' || doc_id AS title, CASE WHEN length(line) > 137 THEN left(line, 137) || '...' ELSE line END AS paragraph FROM p"""
)
def page_parts_whole(spark, d):
    b = F.col("body")
    return wiki_whole(spark, d).select("slug", F.regexp_replace(F.element_at(T.observations(b), 1), "^- ", "").alias("first_observation"), T.human_title(b).alias("title"), T.first_paragraph(b).alias("paragraph"))
