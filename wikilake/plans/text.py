"""Queries over Markdown, HTML, threads, event windows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.functions import pdf as P
from wikilake.functions import text as T
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry
from wikilake.streaming import windows

QUERIES, SQL, query = registry()


def _whole(spark, d):
    """The markup with the whole text before, in and after the fence, in the section and after it; every fifth fence stays open."""
    k, t = (F.col("doc_id") % 7).cast("string"), F.coalesce("text", F.lit(""))
    s = F.lit
    fence = F.when(F.col("doc_id") % 5 == 4, "").otherwise("```\n")
    text = F.concat(s("# T\n[[a "), k, s("]]\n"), t, s("\n```\n[[hidden]]\n# hidden\n"), t, s("\n"), fence, t, s("\n## Observations\n- [[b|see]]\n"), t, s("\n- [[a "), k, s("]]\n## End\n"), t, s("\n![i](x.png) ![j](http://h/y.png)"))
    return A.table(spark, d, "documents").select("doc_id", text.alias("body"))


@query()
def fence_strip_whole(spark, d):
    return _whole(spark, d).select("doc_id", T.strip_fences(F.col("body")).alias("text"))


@query()
def wikilinks_extract_whole(spark, d):
    return _whole(spark, d).select("doc_id", F.array_join(T.wikilinks(F.col("body")), ",").alias("links"))


@query(
    """WITH x AS (SELECT doc_id, regexp_extract(chr(10) || '- [[b|see]]' || chr(10) || coalesce(text, '') || chr(10) || '- [[a ' || doc_id % 7 || ']]' || chr(10) || '## End', '(?s)^(.*?)\\n##? ', 1) AS own FROM documents),
    t AS (SELECT doc_id, regexp_replace(own, '^\\s+|\\s+$', '', 'g') AS s FROM x)
    SELECT doc_id, s AS section, CAST(len(list_filter(string_split(s, chr(10)), lambda y: starts_with(y, '- '))) AS INTEGER) AS bullets, '## Observations' || chr(10) || s AS excerpt FROM t"""
)
def section_extract_whole(spark, d):
    b = F.col("body")
    return _whole(spark, d).select("doc_id", T.section(b, "Observations").alias("section"), F.size(T.observations(b)).alias("bullets"), T.excerpt(b, ("Observations", "Missing")).alias("excerpt"))


@query()
def md_features_whole(spark, d):
    return _whole(spark, d).select("doc_id", T.feature_row(F.col("body")).alias("f")).select("doc_id", "f.*")


@query(
    """SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS headings, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '```'))) AS fences,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\|.*\\|\\s*$'))) AS table_rows, len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)')) AS images FROM documents"""
)
def md_structure(spark, d):
    return A.table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in T.structure(F.col("text")).items()))


@query()
def structural_rules(spark, d):
    """A lateral join with the table function; the tests compare it with a loop."""
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return docs.lateralJoin(M.StructuralRules(F.col("text").outer())).select("doc_id", "rule", "line", "detail")


@query("SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+[|–-]\\s+[^|–-]{1,40}$', '') AS title, CAST(NULL AS VARCHAR) AS description FROM pages")
def html_title_meta(spark, d):
    p = F.col("html")
    return A.table(spark, d, "pages").select("page_id", M.title_of(p).alias("title"), M.meta(p, "description").alias("description"))


@query("SELECT page_id, length(t) AS n_chars, sha256(t) AS sha FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)")
def html_text(spark, d):
    t = M.text_of(F.col("html"))
    return A.table(spark, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query()
def html_to_markdown(spark, d):
    return A.table(spark, d, "pages").select("page_id", M.html_to_markdown(F.col("html")).alias("markdown"))


@query()
def post_cleanup(spark, d):
    rows = A.table(spark, d, "pages").select("page_id", M.post_cleanups(M.html_to_markdown(F.col("html")), F.col("url")).alias("c"))
    return rows.select("page_id", "c.text", F.array_join("c.applied", ",").alias("applied"))


@query()
def pdf_text_clean(spark, d):
    return A.table(spark, d, "documents").select("doc_id", P.pdf_text(F.col("text")).alias("text"))


@query("SELECT conv_id, string_agg(concat('**', role, '**: ', text), chr(10) || chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY conv_id")
def thread_render(spark, d):
    posts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), "text").alias("line"))))
    rows = A.table(spark, d, "conversations").groupBy("conv_id").agg(posts.alias("posts"))
    return rows.select("conv_id", F.array_join(F.transform("posts", lambda p: p.line), "\n\n").alias("thread"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return windows.tumbling(A.table(spark, d, "events"), "1 hour")


@query(
    """SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL"""
)
def events_sliding(spark, d):
    return windows.sliding(A.table(spark, d, "events"), "1 hour", "30 minutes")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, d):
    return windows.sessions(A.table(spark, d, "events"), "30 minutes")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest(spark, d):
    return windows.run_once(windows.latest(windows.read_events(spark, d)), "complete")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return windows.run_once(windows.tumbling(windows.read_events(spark, d), "1 hour"), "complete")


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases FROM events GROUP BY user_id")
def stream_state_fold(spark, d):
    return windows.run_once(windows.fold(windows.read_events(spark, d)), "update", key="user_id")
