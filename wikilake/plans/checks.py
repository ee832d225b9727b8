"""Queries over checks, audits, quality and failure kinds that take rows of several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.functions import urls as U
from wikilake.operators import audit, curation, graph, lint, quality, report
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()
_ISSUE = "SELECT '{}' AS kind, '{}' AS severity, CAST({} AS VARCHAR) AS path, CAST({} AS VARCHAR) AS detail "


@query("SELECT 'sources-index' AS kind, CASE WHEN p IS NULL THEN 'error' ELSE 'warn' END AS severity, CAST(o_orderkey AS VARCHAR) AS path, coalesce(CAST(p AS VARCHAR), 'no path') AS detail FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS p FROM orders) WHERE p IS NULL OR p NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def lint_sources_index(spark, d):
    path = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey"))
    entries = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), path.cast("string").alias("repo_path"))
    files = A.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("repo_path"))
    return lint.sources_index(entries, files)


@query(
    """SELECT 'source-image-refs' AS kind, 'error' AS severity, CAST(l_orderkey AS VARCHAR) AS path, concat(l_partkey, ':', why) AS detail FROM (SELECT l_orderkey, l_partkey, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size * 40 < 512 THEN 'small' WHEN p_size % 5 = 0 THEN 'no image' END AS why
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 11 > 0) p ON l_partkey = p_partkey WHERE l_linenumber = 1) WHERE why IS NOT NULL"""
)
def lint_image_refs(spark, d):
    refs = A.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("ref"))
    files = A.table(spark, d, "part").where("p_partkey % 11 > 0").select(F.col("p_partkey").alias("ref"), (F.col("p_size") * 40).alias("bytes"), (F.col("p_size") % 5 != 0).alias("is_image"))
    return lint.image_refs(refs, files)


@query(
    """WITH s AS (SELECT p_partkey AS path, p_size % 6 AS raw_images, p_size % 2 AS raw_svgs, p_size * 3000 AS raw_bytes, p_size * 20 AS raw_chars, p_partkey % 8 AS refs, p_partkey % 10 = 0 AS declined FROM part),
    w AS (SELECT *, list_filter([CASE WHEN raw_svgs > 0 THEN 'svg' END, CASE WHEN raw_bytes >= 100000 THEN 'large' END, CASE WHEN raw_images >= 3 THEN 'many' END, CASE WHEN raw_images > 0 AND raw_chars < 500 THEN 'thin' END,
      CASE WHEN raw_images > 0 AND raw_chars / greatest(raw_images, 1) < 200 THEN 'dense' END], lambda x: x IS NOT NULL) AS why FROM s), f AS (SELECT *, len(why) > 0 AND refs < least(2, raw_images) AND NOT declined AS few FROM w)
    SELECT 'source-image-count' AS kind, 'warn' AS severity, CAST(path AS VARCHAR) AS path, CASE WHEN few THEN array_to_string(why, ',') ELSE 'too many' END AS detail FROM f WHERE few OR refs > 5"""
)
def lint_image_count(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = A.table(spark, d, "part").select(k.alias("path"), (s % 6).alias("raw_images"), (s % 2).alias("raw_svgs"), (s * 3000).alias("raw_bytes"), (s * 20).alias("raw_chars"), (k % 8).alias("refs"), (k % 10 == 0).alias("declined"))
    return lint.image_count(rows)


_GAPS = ", gaps AS (SELECT dst, count(*) AS n_citing, count(*) FILTER (WHERE src % 3 > 0) AS n_missing FROM cites GROUP BY dst)"


@query(A.with_(A.CITES, A.ITEMS) + _GAPS + _ISSUE.format("observation-gaps", "warn", "dst", "n_missing") + "FROM gaps JOIN items ON key = dst WHERE n_missing > 0 AND tier = 'active'")
def lint_observation_gaps(spark, d):
    cites = A.cites(spark, d)
    return lint.observation_gaps(graph.observation_gaps(cites, cites.where("src % 3 = 0")), A.items(spark, d), "key")


_TOPIC = "concat('## What', chr(10), CASE WHEN doc_id % 2 = 0 THEN '_TBD_' ELSE 'known' END, chr(10), '## Current understanding', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'stub, to come' END, chr(10), '## Other', chr(10), coalesce(text, ''))"


def _topics(spark, d):
    i, s = F.col("doc_id"), F.lit
    body = F.concat(s("## What\n"), F.when(i % 2 == 0, "_TBD_").otherwise("known"), s("\n## Current understanding\n"), F.when(i % 3 == 0, "").otherwise("stub, to come"), s("\n## Other\n"), F.coalesce("text", s("")))
    return A.table(spark, d, "documents").select(i.alias("path"), (i % 7).alias("source_count"), body.alias("body"))


@query("SELECT 'topic-content-gaps' AS kind, 'warn' AS severity, CAST(doc_id AS VARCHAR) AS path, CAST(doc_id % 7 AS VARCHAR) AS detail FROM documents WHERE doc_id % 7 >= 3 AND doc_id % 2 = 0")
def lint_topic_gaps(spark, d):
    return lint.topic_content_gaps(_topics(spark, d))


@query("SELECT 'comparison-table-missing' AS kind, 'warn' AS severity, CAST(doc_id AS VARCHAR) AS path, CAST(doc_id % 5 AS VARCHAR) AS detail FROM documents WHERE doc_id % 5 < 3")
def lint_comparison_table(spark, d):
    s, t = F.lit, F.coalesce("text", F.lit(""))
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat(t, s("\n## Comparison\n"), F.repeat(s("| a | b |\n"), (F.col("doc_id") % 5).cast("int")), s("\n## End\n| c |\n"), t).alias("body"))
    return lint.comparison_table_missing(rows)


@query(
    """WITH said AS (SELECT doc_id, regexp_extract(concat(chr(10), coalesce(text, ''), chr(10), CASE WHEN doc_id % 2 = 0 THEN 'one Versus two' ELSE 'one and two' END, chr(10), '## Next'), '(?s)^(.*?)\\n##? ', 1) AS s FROM documents),
    names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT unnest(['with', 'and', 'of', 'die', 'que la', 'en el', 'est la', 'in the', 'zu', 'versus'])),
    n AS (SELECT doc_id, count(*) AS n FROM said, names WHERE length(name) >= 3 AND contains(s, name) AND regexp_matches(s, concat('(^|[^A-Za-z0-9])', name, '([^A-Za-z0-9]|$)')) GROUP BY doc_id),
    linked AS (SELECT doc_id, n + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM n)
    SELECT 'comparison-opportunity' AS kind, 'info' AS severity, CAST(doc_id AS VARCHAR) AS path, CAST(linked.n AS VARCHAR) AS detail FROM linked JOIN said USING (doc_id) WHERE linked.n >= 3 AND regexp_matches(s, '(?i)\\bvs\\b|\\bcompared to\\b|\\btradeoff\\b|\\bdiffers from\\b|\\bversus\\b') AND doc_id % 5 > 0"""
)
def lint_comparison_opportunity(spark, d):
    """Names of one word and of several (of parts, too, which no text has), and a link in every third text; every fifth has its table."""
    names = A.table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, ("with", "and", "of", "die", "que la", "en el", "est la", "in the", "zu", "versus")))).alias("name")))
    i, s = F.col("doc_id"), F.lit
    body = F.concat(s("# T\n"), F.when(i % 3 == 0, "[[zu]]\n").otherwise(""), F.when(i % 5 == 0, " ## Comparison \n").otherwise(""), s("## Current understanding\n"), F.coalesce("text", s("")), s("\n"), F.when(i % 2 == 0, "one Versus two").otherwise("one and two"), s("\n## Next\n[[of]"))
    return lint.comparison_opportunity(A.table(spark, d, "documents").select(i.alias("path"), body.alias("body")), names)


_NEWEST = ", newest AS (SELECT dst AS key, max(CAST(o_orderdate AS DATE)) AS newest FROM cites JOIN orders ON src = o_orderkey GROUP BY dst), topics AS (SELECT p_partkey AS key, DATE '1992-01-01' + CAST(p_size * 50 AS INTEGER) AS synthesised, p_size % 5 AS observations FROM part)"


def _stale(spark, d):
    newest = A.dated_cites(spark, d).groupBy(F.col("dst").alias("key")).agg(F.max("updated").alias("newest"))
    topics = A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.date_add(F.to_date(F.lit("1992-01-01")), (F.col("p_size") * 50).cast("int")).alias("synthesised"), (F.col("p_size") % 5).alias("observations"))
    return topics, newest


@query(
    A.with_(A.CITES)
    + _NEWEST
    + """, r AS (SELECT key, CASE WHEN date_diff('day', synthesised, newest) > 7 THEN concat('lag ', date_diff('day', synthesised, newest)) WHEN date_diff('day', synthesised, DATE '1998-01-01') > 30 AND observations >= 3 THEN concat('age ', date_diff('day', synthesised, DATE '1998-01-01')) END AS why FROM topics LEFT JOIN newest USING (key))
    SELECT 'stale-topic-synthesis' AS kind, 'warn' AS severity, CAST(key AS VARCHAR) AS path, why AS detail FROM r WHERE why IS NOT NULL"""
)
def lint_stale_topics(spark, d):
    topics, newest = _stale(spark, d)
    return lint.stale_topics(topics, newest, "1998-01-01", "key")


@query(A.with_(A.CITES) + _NEWEST + "SELECT key, CAST(date_diff('day', synthesised, newest) AS INTEGER) AS days FROM topics JOIN newest USING (key) WHERE newest > synthesised")
def audit_stale_strict(spark, d):
    topics, newest = _stale(spark, d)
    return audit.stale_strict(topics, newest, "key")


@query("SELECT doc_id AS slug, CASE doc_id % 3 WHEN 0 THEN '- now deprecated by x' ELSE '- was Retracted in y' END AS bullet, CASE doc_id % 3 WHEN 0 THEN 'deprecated' ELSE 'retracted' END AS word FROM documents WHERE doc_id % 3 < 2 AND NOT regexp_matches(coalesce(text, ''), '(^|\\n)##? ') AND NOT contains(lower(coalesce(text, '')), 'deprecated') AND NOT contains(lower(coalesce(text, '')), 'retracted')")
def audit_contradictions(spark, d):
    s, t, i = F.lit, F.coalesce("text", F.lit("")), F.col("doc_id")
    ok = ~t.rlike(r"(^|\n)##? ") & ~F.contains(F.lower(t), s("deprecated")) & ~F.contains(F.lower(t), s("retracted"))
    body = F.concat(s("## Synthesis\n"), t, F.when(i % 3 == 2, " but incorrect, it says").otherwise(""), s("\n## Observations\n- plain\n"), F.when(i % 3 == 0, "- now deprecated by x\n- incorrect z").when(i % 3 == 1, "- was Retracted in y\n- no longer so").otherwise("- this was incorrect"))
    return audit.contradictions(A.table(spark, d, "documents").where(ok).select(i.alias("slug"), body.alias("body")))


@query("SELECT o_orderkey AS slug FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def audit_dead_urls(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("slug"), "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("short-body"), F.lit("dead-link"))).otherwise(F.array(F.lit("short-body"))).alias("flags"))
    pinned = A.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("slug"))
    return audit.dead_urls(o, pinned).select(F.col("o_orderkey").alias("slug"))


@query("SELECT c_custkey AS slug FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def audit_deleted_bookmarks(spark, d):
    sources = A.table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_custkey").alias("norm_url"))
    marks = A.table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("norm_url"))
    gone = audit.deleted_bookmarks(sources, marks).select("slug")
    return gone.unionByName(audit.deleted_bookmarks(sources, marks.limit(0)).select("slug"))  # without bookmarks there is none


@query("SELECT o_orderkey AS slug FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01') > 90 AND (o_orderkey % 4 = 0 OR date_diff('day', CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER), DATE '1997-01-01') > 90)")
def audit_head_stale(spark, d):
    day = F.to_date("o_orderdate")
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), day.alias("updated"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day, (F.col("o_orderkey") % 400).cast("int"))).alias("checked"))
    return audit.head_stale(rows, "1997-01-01").select("slug")


@query(
    """WITH x AS (SELECT doc_id, string_split(concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 1 THEN '' ELSE concat(chr(10), '[[x]]') END), chr(10)) AS rows FROM documents), l AS (SELECT doc_id, unnest(rows) AS line, generate_subscripts(rows, 1) AS place FROM x),
    f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) % 2 = 0 AS out FROM l)
    SELECT doc_id AS slug FROM f GROUP BY doc_id HAVING count(*) FILTER (WHERE out AND regexp_matches(line, '\\[\\[([^\\]|]+)(\\|[^\\]]*)?\\]\\]')) = 0"""
)
def audit_zero_links(spark, d):
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 1, "").otherwise("\n[[x]]"))
    return audit.zero_links(A.table(spark, d, "documents").select(F.col("doc_id").alias("slug"), T.wikilinks(body).alias("links"))).select("slug")


_LONG = "length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))"


@query(
    f"""WITH h AS (SELECT doc_id, {_LONG} AS n, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, CASE doc_id % 4 WHEN 0 THEN 'github.com' WHEN 1 THEN 'arxiv.org' WHEN 2 THEN 'sebastianraschka.com' ELSE 'linux.do' END AS host, doc_id % 5 AS k, doc_id % 6 AS declared FROM documents),
    e AS (SELECT *, CASE host WHEN 'github.com' THEN 1000 WHEN 'arxiv.org' THEN 1500 WHEN 'sebastianraschka.com' THEN 3000 ELSE 0 END AS least, k IN (0, 1) AS exempt, len(regexp_extract_all(t, '(?m)^#{{1,6}}\\s+\\S')) AS headings FROM h)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT exempt AND n < 500 THEN 'short-body' END, CASE WHEN NOT exempt AND n >= 500 AND n < least THEN 'below-host-expected-size' END,
      CASE WHEN k <> 0 AND n >= 2000 AND headings = 0 AND NOT (NOT exempt AND (n < 500 OR n < least)) THEN 'no-headings-in-body' END, CASE WHEN declared > 0 AND doc_id % 7 = 0 THEN 'images-declared-but-none-downloaded' END,
      CASE k WHEN 0 THEN 'intentional-stub' WHEN 1 THEN 'pdf-rendered' WHEN 2 THEN 'reddit-deleted' END], lambda x: x IS NOT NULL), ',') AS flags,
      CASE WHEN len(list_filter([NOT exempt AND n < 500, NOT exempt AND n >= 500 AND n < least, k <> 0 AND n >= 2000 AND headings = 0 AND NOT (NOT exempt AND (n < 500 OR n < least)), declared > 0 AND doc_id % 7 = 0, k = 2], lambda x: x)) > 0 THEN 'flagged' ELSE 'good' END AS status FROM e"""
)
def quality_of_hosts(spark, d):
    """Hosts with a size of their own, declared images, and flags of the caller."""
    i = F.col("doc_id")
    host = F.when(i % 4 == 0, "github.com").when(i % 4 == 1, "arxiv.org").when(i % 4 == 2, "sebastianraschka.com").otherwise("linux.do")
    k = i % 5
    extra = F.when(k == 0, F.array(F.lit("intentional-stub"))).when(k == 1, F.array(F.lit("pdf-rendered"))).when(k == 2, F.array(F.lit("reddit-deleted")))
    own = quality.flags(F.regexp_replace(F.col("text"), "Loading|Sign in|Log in|Please wait|Open in", "x"), host, None, i % 6, F.when(i % 7 == 0, 0).otherwise(1), extra)
    rows = A.table(spark, d, "documents").select("doc_id", own.alias("flags"))
    return rows.select("doc_id", F.array_join("flags", ",").alias("flags"), quality.status(F.col("flags")).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'reddit-deleted,loading-skeleton' WHEN doc_id % 3 = 1 THEN 'loading-skeleton' ELSE 'feishu-deleted,loading-skeleton' END AS flags FROM documents")
def quality_reclassified(spark, d):
    i, a = F.col("doc_id"), lambda *x: F.array(*map(F.lit, x))
    old = F.when(i % 3 == 0, a("short-body", "reddit-deleted")).when(i % 3 == 1, a("login-wall-keyword")).otherwise(a("feishu-deleted", "short-body"))
    return A.table(spark, d, "documents").select("doc_id", F.array_join(quality.reclassified(old, a("loading-skeleton")), ",").alias("flags"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'create' WHEN doc_id % 4 = 1 THEN 'append' WHEN n_chars < 500 AND doc_id % 5 > 0 AND n_chars < (1000 + doc_id % 1000) * 0.3 THEN 'regression-protected' ELSE 'overwrite' END AS decision FROM documents")
def archive_decisions(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    old = F.when(i % 4 != 0, 1000 + i % 1000)
    return A.table(spark, d, "documents").select("doc_id", quality.archive_decision(old, F.lit(False), n, n < 500, i % 4 >= 2, i % 5 == 0).alias("decision"))


#: (flags, kind) of each branch of the failure cascade that flags alone decide, for fetched pages of an article's address.
_BRANCHES = (
    (("intentional-stub", "_default-non-html"), "upstream-not-html"),
    (("intentional-stub", "arxiv-pdf"), "upstream-not-html"),
    (("intentional-stub", "huggingface-space"), "intentional-stub-app-only"),
    (("intentional-stub", "qwen-ai-non-article"), "intentional-stub-app-only"),
    (("intentional-stub", "feishu-auth-gated"), "upstream-auth-gated"),
    (("intentional-stub", "xhs-text-body-unavailable"), "upstream-auth-gated"),
    (("intentional-stub", "reddit-deleted"), "upstream-deleted"),
    (("intentional-stub", "x-not-found"), "upstream-deleted"),
    (("intentional-stub", "_default-fetch-failed"), "upstream-spa-no-content"),
    (("intentional-stub", "loading-skeleton"), "upstream-spa-no-content"),
    (("intentional-stub", "github-fetch-failed"), "upstream-fetch-failed"),
    (("intentional-stub", "zhihu-bot-blocked"), "upstream-fetch-failed"),
    (("intentional-stub", "login-wall-keyword"), "upstream-paywall"),
    (("intentional-stub",), "upstream-fetch-failed"),
    (("login-wall-keyword",), "upstream-paywall"),
    (("images-declared-but-none-downloaded",), "content-incomplete-images-zero"),
    (("weixin-image-download-partial",), "content-incomplete-images"),
    (("short-body",), "content-too-short"),
    (("below-host-expected-size",), "content-too-short"),
    (("loading-skeleton",), "upstream-spa-no-content"),
    (("pdf-rendered", "login-wall-keyword"), "clean"),
    (("pdf-marker",), "clean"),
)
_BY_BRANCH = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(_BRANCHES))


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'upstream-paywall' ELSE CASE o_orderkey % {len(_BRANCHES)} {_BY_BRANCH} END END AS kind FROM orders WHERE o_custkey % 13 > 0 OR o_orderkey % {len(_BRANCHES)} = {len(_BRANCHES) - 1}")
def failure_branches(spark, d):
    flags = F.array(*(F.array(*map(F.lit, names)) for names, _ in _BRANCHES))
    n = len(_BRANCHES)
    rows = A.table(spark, d, "orders").where(f"o_custkey % 13 > 0 or o_orderkey % {n} = {n - 1}")
    url = F.when(F.col("o_custkey") % 13 == 0, "https://www.wsj.com/articles/x").otherwise("https://h.example.org/post/x")
    return rows.select("o_orderkey", quality.failure_kind(url, F.lit(True), flags[(F.col("o_orderkey") % n).cast("int")]).alias("kind"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' WHEN 2 THEN 'same' WHEN 3 THEN 'changed' ELSE 'unknown' END AS answer FROM orders")
def head_checks(spark, d):
    from wikilake.operators import state

    k, a = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    old_tag, new_tag = F.when(k < 2, a), F.when(k == 0, a).when(k == 1, "new")
    return A.table(spark, d, "orders").select("o_orderkey", state.head_check(old_tag, new_tag, F.when(k.isin(2, 3), a), F.when(k == 2, a).when(k == 3, "new")).alias("answer"))


@query("SELECT c_custkey AS slug FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def orphans_to_delete(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "seen").otherwise("active").alias("tier"))
    cites = A.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    cites = cites.withColumn("src", -F.col("src"))  # no page cites itself
    return curation.orphans_to_delete(graph.with_refs(c, cites, "key")).select(F.col("key").alias("slug"))


@query("SELECT c_custkey AS slug FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sources_deletable(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("slug"))
    cites = A.table(spark, d, "orders").select((-F.col("o_orderkey")).alias("src"), F.col("o_custkey").alias("dst"))
    return curation.deletable(c, cites)


@query("SELECT n_nationkey, concat('---', chr(10), 'type: entity', chr(10), 'created: 2024-01-02', chr(10), 'updated: 2024-01-02', chr(10), 'refs: 0', chr(10), 'tier: seen', chr(10), '---', chr(10), '# ', n_name, chr(10), chr(10), '## Synthesis', chr(10), chr(10), '## Observations', chr(10)) AS page, NOT contains(n_name, ' ') AS valid FROM nation")
def scaffolds(spark, d):
    n = A.table(spark, d, "nation")
    return n.select("n_nationkey", curation.scaffold("entity", F.col("n_name"), F.lit("2024-01-02")).alias("page"), curation.valid_name(F.replace("n_name", F.lit(" "), F.lit("/"))).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-03-04' WHEN doc_id % 3 = 1 THEN '2024-01-02' END AS day FROM documents")
def dates_backfilled(spark, d):
    i, t = F.col("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^#", " #")
    body = F.concat(F.lit("## Synthesis\n"), F.when(i % 3 == 2, "TODO").otherwise("It is."), F.lit("\n## Rest\n"), t)
    return A.table(spark, d, "documents").select("doc_id", curation.backfilled_date(F.when(i % 3 == 0, "2024-03-04"), body, F.lit("2024-01-02")).alias("day"))


@query("SELECT doc_id, concat('# Log', chr(10), '<!-- entries -->', chr(10), 'new ', doc_id, chr(10), coalesce(text, '')) AS log FROM documents")
def log_prepended(spark, d):
    return A.table(spark, d, "documents").select("doc_id", curation.prepended(F.concat(F.lit("# Log\n<!-- entries -->\n"), F.coalesce("text", F.lit(""))), F.concat(F.lit("new "), F.col("doc_id").cast("string"))).alias("log"))


@query("SELECT name, side FROM (SELECT n_name AS name, 'missing' AS side FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 UNION ALL SELECT n_name, 'unmatched' FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 2 = 0)")
def batch_unmatched(spark, d):
    n = A.table(spark, d, "nation")
    return curation.unmatched(n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")))


@query(A.with_(A.CITES, A.REFS, A.ITEMS) + ", x AS (SELECT count(*) AS n FROM items LEFT JOIN refs ON key = dst WHERE (tier = 'seen' AND coalesce(refs, 0) >= 3) OR (tier = 'active' AND coalesce(refs, 0) < 3)) SELECT n + (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS findings FROM x")
def findings_counted(spark, d):
    rows = graph.with_refs(A.items(spark, d), A.cites(spark, d), "key")
    issues = lint.run(lint.tier_mismatch(rows, "key"), lint.orphans(A.items(spark, d), A.cites(spark, d), "key"))
    return curation.finding_count(issues, A.table(spark, d, "customer").where("c_acctbal < 0"))


@query(
    A.with_(A.CITES, A.REFS, A.ITEMS)
    + """, x AS (SELECT concat('- [', CASE WHEN tier = 'seen' THEN 'error' ELSE 'warn' END, '] tier-mismatch — ', key, ': ', tier, ':', coalesce(refs, 0)) AS line FROM items LEFT JOIN refs ON key = dst WHERE (tier = 'seen' AND coalesce(refs, 0) >= 3) OR (tier = 'active' AND coalesce(refs, 0) < 3))
    SELECT line, (SELECT count(*) FROM x) AS total FROM x ORDER BY line LIMIT 30"""
)
def findings_selected(spark, d):
    rows = graph.with_refs(A.items(spark, d), A.cites(spark, d), "key")
    return curation.selected_findings(lint.run(lint.tier_mismatch(rows, "key"), lint.orphans(A.items(spark, d), A.cites(spark, d), "key")))


@query("SELECT p_partkey AS key, p_size % 7 AS n_sources, p_size % 5 AS stored FROM part WHERE p_size % 7 <> p_size % 5")
def plan_topic_updates(spark, d):
    return graph.plan_topic_updates(A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 5).alias("stored"), (F.col("p_size") % 7).alias("n_sources")))


@query("SELECT page_id, DATE '2024-01-02' + CAST(page_id % 300 AS INTEGER) AS day FROM pages")
def published_dates(spark, d):
    """The four places of a date, in turn, before the whole page."""
    k, s = F.col("page_id") % 4, F.lit
    day = F.date_add(F.to_date(s("2024-01-02")), (F.col("page_id") % 300).cast("int")).cast("string")
    meta = F.when(k == 0, F.concat(s('<meta property="article:published_time" content="'), day, s('T01:02:03Z">'))).when(k == 1, F.concat(s('<meta name="date" content="'), day, s('">')))
    other = F.when(k == 2, F.concat(s('{"datePublished": "'), day, s('"}'))).otherwise(F.concat(s('<time datetime="'), day, s('">')))
    return A.table(spark, d, "pages").select("page_id", report.published_date(F.concat(F.coalesce(meta, other), "html")).alias("day"))


@query(f"SELECT page_id, regexp_matches(lower({A.sql_part('url', 3)}), '/(blog|post|posts|article|articles|p|news|[0-9]{{4}})/.+|\\.html?$') AS article FROM pages")
def urls_of_articles(spark, d):
    return A.table(spark, d, "pages").select("page_id", U.looks_like_article(F.col("url")).alias("article"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^.*r.d.*$')")
def globs(spark, d):
    return A.table(spark, d, "part").where(F.col("p_name").rlike(T.glob_rule("*r?d*"))).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '-' WHEN event_id % 4 = 1 THEN printf('%.2e', CAST(event_id + 1 AS DOUBLE) * 1e9) WHEN event_id % 4 = 2 THEN 'a\\|b' ELSE CAST(event_id AS VARCHAR) END AS cell FROM events")
def cells_formatted(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.when(i % 8 == 0, " ")).when(i % 4 == 1, ((i + 1).cast("double") * 1e9).cast("string")).when(i % 4 == 2, "a|b").otherwise(i.cast("string"))
    return A.table(spark, d, "events").select("event_id", T.format_cell(raw).alias("cell"))
