"""Queries over URLs, pipeline state, revisions and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import urls as U
from wikilake.operators import audit, dedupe, revisions, state
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()
_B, _R = A.with_(A.BOOKMARKS), A.with_(A.REVISIONS)
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(h, '{rule}') AND regexp_matches(p, '{path}') THEN '{name}'" for name, rule, path in U.SITE_RULES) + f" ELSE '{U.DEFAULT_SITE}' END"
#: Pages moved to hosts that have a site of their own.
_MOVED = "CASE page_id % 6 WHEN 0 THEN 'https://www.github.com/a/b' WHEN 1 THEN 'https://zhihu.com/question/1/answer/2' WHEN 2 THEN 'https://zhihu.com/people/x' WHEN 3 THEN 'https://docs.x.readthedocs.io/en' WHEN 4 THEN 'https://v2ex.com/t/12' ELSE url END"
#: Raw content of three quarters of the pages; every sixth page has been ingested.
_STATE = """, raw AS (SELECT bookmark_id AS slug, norm_url, host, CASE WHEN length(title) >= 30 THEN 'good' ELSE 'flagged' END AS quality FROM bookmarks WHERE bookmark_id % 4 > 0),
  ingested AS (SELECT DISTINCT norm_url FROM bookmarks WHERE bookmark_id % 6 = 0)"""


def _raw(spark, d):
    b = A.bookmarks(spark, d)
    return b.where("bookmark_id % 4 > 0").select(F.col("bookmark_id").alias("slug"), "link", "norm_url", "host", F.when(F.length("title") >= 30, "good").otherwise("flagged").alias("quality"))


def _ingested(spark, d):
    return A.bookmarks(spark, d).where("bookmark_id % 6 = 0").select("norm_url").distinct()


@query(f"SELECT page_id, {A.sql_norm('url')} AS norm_url, {A.sql_host('url')} AS hostname, regexp_replace({A.sql_host('url')}, '^www\\.', '') AS host FROM pages")
def url_normalize(spark, d):
    u = F.col("url")
    return A.table(spark, d, "pages").select("page_id", U.normalize_url(u).alias("norm_url"), U.hostname_of(u).alias("hostname"), U.host_of(u).alias("host"))


@query(_B + "SELECT norm_url AS key, count(*) AS n, min(bookmark_id) AS first FROM bookmarks GROUP BY norm_url HAVING count(*) > 1")
def url_duplicates(spark, d):
    return dedupe.url_groups(A.bookmarks(spark, d))


@query(_B + "SELECT host, count(*) AS bookmarks, count(DISTINCT norm_url) AS urls, count(*) > 1 AS uncovered FROM bookmarks GROUP BY host")
def host_counts(spark, d):
    return state.host_report(A.bookmarks(spark, d))


@query(
    _B
    + """, now AS (SELECT host, count(*) AS n FROM bookmarks GROUP BY host), was AS (SELECT host, count(*) AS was FROM bookmarks WHERE bookmark_id % 3 = 0 GROUP BY host)
    SELECT host, n, change FROM (SELECT host, n, CASE WHEN was = 1 AND n >= 2 THEN 'graduated' WHEN was IS NULL AND n >= 2 THEN 'brand-new' WHEN was IS NULL THEN 'new-singleton' END AS change FROM now LEFT JOIN was USING (host)) WHERE change IS NOT NULL"""
)
def host_graduation(spark, d):
    counts = lambda b: b.groupBy("host").agg(F.count("*").alias("n"))
    b = A.bookmarks(spark, d)
    return state.graduations(counts(b), counts(b.where("bookmark_id % 3 = 0")))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('https://share.google/?link=', url_encode(url)) END AS link, url AS target FROM pages")
def url_unwrap_all(spark, d):
    link = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://share.google/?link="), F.url_encode("url")))
    return A.table(spark, d, "pages").select("page_id", link.alias("link")).withColumn("target", U.unwrap_share_url(F.col("link")))


@query(f"SELECT page_id, h AS host FROM (SELECT page_id, {A.sql_host('url')} AS h FROM pages) WHERE h = 'example.org' OR suffix(h, '.example.org')")
def host_suffix_filter(spark, d):
    h = A.table(spark, d, "pages").select("page_id", U.hostname_of(F.col("url")).alias("host"))
    return h.where(U.host_matches(F.col("host"), F.lit("example.org")))


@query(f"SELECT page_id, {_ROUTE} AS site FROM (SELECT page_id, regexp_replace({A.sql_host('u')}, '^www\\.', '') AS h, {A.sql_part('u', 3)} AS p FROM (SELECT page_id, {_MOVED} AS u FROM pages))")
def route_site(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.expr(_MOVED).alias("u")).select("page_id", U.route_site(F.col("u")).alias("site"))


@query(
    f"""WITH h AS (SELECT n.n_regionkey AS key, list(DISTINCT concat(lower(replace(n_name, ' ', '')), '.region', n.n_regionkey, '.example.com')) AS hosts FROM nation n GROUP BY 1)
    SELECT key, concat('region', key, '.example.com') AS suffix FROM h"""
)
def host_common_suffix(spark, d):
    n = A.table(spark, d, "nation")
    host = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".region"), F.col("n_regionkey").cast("string"), F.lit(".example.com"))
    return n.groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_set(host).alias("hosts")).select("key", U.common_host_suffix(F.col("hosts")).alias("suffix"))


@query(
    """SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^0-9a-z_\\-\\s]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), 40), '^-|-$', '', 'g') AS slug,
    CASE WHEN p_size % 2 = 0 THEN 2000 + p_size ELSE 1999 END AS year FROM part"""
)
def slugify(spark, d):
    p = A.table(spark, d, "part")
    dated = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") + 2000).cast("string"), F.lit("-01-02-x"))).otherwise("x")
    return p.select("p_partkey", U.slugify(F.col("p_name")).alias("slug"), U.year_for_slug(dated, 1999).alias("year"))


@query(
    f"""WITH p AS (SELECT page_id, {A.sql_part('url', 1)} AS s, {A.sql_part('url', 2)} AS a, regexp_replace({A.sql_part('url', 3)}, '[^/]*$', '') AS f FROM pages)
    SELECT page_id, concat(s, '://', a, CASE WHEN f = '' THEN '/' ELSE f END, 'img/a.png') AS relative, concat(s, '://', a, '/b.png') AS rooted, concat('page-img-', printf('%03d', page_id), '.jpg') AS name FROM p"""
)
def image_urls_resolved_all(spark, d):
    u = F.col("url")
    rows = A.table(spark, d, "pages")
    return rows.select("page_id", U.resolve_against(u, F.lit("./img/a.png")).alias("relative"), U.resolve_against(u, F.lit("/b.png")).alias("rooted"), U.local_image_name(F.lit("page"), F.col("page_id"), u).alias("name"))


@query(
    _B
    + _STATE
    + """SELECT slug, CASE WHEN i.norm_url IS NOT NULL THEN 'ingested' WHEN quality <> 'good' THEN 'not-yet-good' ELSE 'ingest-ready' END AS state,
    (SELECT min(bookmark_id) FROM bookmarks b WHERE b.norm_url = raw.norm_url) AS bookmark_id FROM raw LEFT JOIN ingested i USING (norm_url)"""
)
def pipeline_state(spark, d):
    return state.raw_index(_raw(spark, d), A.bookmarks(spark, d), _ingested(spark, d)).select("slug", "state", "bookmark_id")


_KIND = "CASE WHEN quality = 'good' THEN 'clean' ELSE 'content-too-short' END"
_ROWS = f""", kinds AS (SELECT norm_url, slug, {_KIND} AS kind FROM raw WHERE slug % 5 > 0), marks AS (SELECT bookmark_id, norm_url FROM bookmarks WHERE bookmark_id % 7 > 0),
  rows_ AS (SELECT bookmark_id, norm_url, slug, coalesce(kind, 'not-yet-fetched') AS kind FROM marks LEFT JOIN kinds USING (norm_url)
    UNION ALL SELECT NULL, norm_url, slug, kind FROM kinds WHERE norm_url NOT IN (SELECT norm_url FROM marks))"""


def _status(spark, d):
    kind = F.when(F.col("quality") == "good", "clean").otherwise("content-too-short")
    raw = _raw(spark, d).where("slug % 5 > 0").select("norm_url", "slug", kind.alias("kind"))
    return state.status_rows(A.bookmarks(spark, d).where("bookmark_id % 7 > 0").select("bookmark_id", "norm_url"), raw)


@query(_B + _STATE + _ROWS + "SELECT bookmark_id, norm_url, slug, kind FROM rows_")
def status_rows(spark, d):
    return _status(spark, d)


@query(_B + _STATE + _ROWS + "SELECT g AS \"group\", kind, count(*) AS n FROM (SELECT regexp_extract(kind, '^([a-z]+)', 1) AS g, kind FROM rows_) GROUP BY ROLLUP (g, kind)")
def status_rollup(spark, d):
    return state.by_kind(_status(spark, d))


@query(_B + _STATE + "SELECT bookmark_id, norm_url FROM bookmarks WHERE norm_url NOT IN (SELECT norm_url FROM ingested)")
def new_bookmarks(spark, d):
    return state.new_bookmarks(A.bookmarks(spark, d), _ingested(spark, d)).select("bookmark_id", "norm_url")


@query(
    _B
    + _STATE
    + """SELECT slug, norm_url FROM raw WHERE quality = 'good' AND host <> '' AND slug NOT IN (SELECT bookmark_id FROM bookmarks WHERE bookmark_id % 10 = 1)
    AND norm_url NOT IN (SELECT norm_url FROM ingested) AND NOT (host = 'example.net' OR suffix(host, '.example.net'))"""
)
def ingest_candidates(spark, d):
    slugs = A.bookmarks(spark, d).where("bookmark_id % 10 = 1").select(F.col("bookmark_id").alias("slug"))
    excluded = spark.range(1).select(F.lit("example.net").alias("suffix"))
    return state.ingest_candidates(_raw(spark, d), slugs, _ingested(spark, d), excluded).select("slug", "norm_url")


@query(
    _B
    + _STATE
    + """, one AS (SELECT norm_url, min(bookmark_id) AS bookmark_id, arg_min(host, bookmark_id) AS slug FROM bookmarks GROUP BY norm_url),
    named AS (SELECT norm_url, bookmark_id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY bookmark_id) > 1 THEN concat(slug, '-', bookmark_id) ELSE slug END AS slug FROM one)
    SELECT bookmark_id, n.slug, CASE WHEN bookmark_id % 9 = 0 THEN 'skip' WHEN r.quality = 'good' THEN 'keep' WHEN r.quality IS NOT NULL THEN 'retry' ELSE 'fetch' END AS action
    FROM named n LEFT JOIN (SELECT norm_url, min(quality) AS quality FROM raw WHERE slug % 2 = 0 GROUP BY norm_url) r USING (norm_url)"""
)
def fetch_plan(spark, d):
    b = A.bookmarks(spark, d).withColumn("slug", F.col("host"))
    raw = _raw(spark, d).where("slug % 2 = 0").groupBy("norm_url").agg(F.min("quality").alias("quality"))
    one = b.groupBy("norm_url").agg(F.min("bookmark_id").alias("bookmark_id")).where("bookmark_id % 9 = 0")
    return state.fetch_plan(b, raw, one).select("bookmark_id", "slug", "action")


@query(
    """WITH p AS (SELECT page_id, page_id % 3 <> 1 AS counts FROM pages), r AS (SELECT *, sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (ORDER BY page_id DESC) AS n FROM p)
    SELECT page_id, counts FROM r WHERE n <= 20"""
)
def fetch_plan_running_limit(spark, d):
    rows = A.table(spark, d, "pages").select("page_id", (F.col("page_id") % 3 != 1).alias("counts"))
    return state.running_limit(rows, F.col("counts"), 20, "-page_id")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'skip-frozen' WHEN o_orderpriority LIKE '5%' THEN 'skip-host' WHEN o_orderkey % 11 = 0 THEN 'skip-decided' WHEN o_orderkey % 13 = 0 THEN 'skip-pinned'
    WHEN o_totalprice < 20000 THEN 'fetch' WHEN o_orderstatus = 'F' AND o_totalprice < 90000 THEN 'retry' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'refresh' WHEN o_orderkey % 2 = 0 THEN 'head-check' ELSE 'keep' END AS action FROM orders"""
)
def sync_plan_cascade(spark, d):
    c = F.col
    row = {
        "frozen": c("o_orderstatus") == "P",
        "excluded": c("o_orderpriority").startswith("5"),
        "decided": c("o_orderkey") % 11 == 0,
        "pinned": c("o_orderkey") % 13 == 0,
        "missing": c("o_totalprice") < 20000,
        "retry": (c("o_orderstatus") == "F") & (c("o_totalprice") < 90000),
        "aged": c("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"),
        "checked": c("o_orderkey") % 2 == 0,
    }
    return A.table(spark, d, "orders").select("o_orderkey", state.sync_action(row).alias("action"))


@query("SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS status FROM events GROUP BY user_id) GROUP BY status")
def queue_status_counts(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return state.queue_fold(e).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def skip_list(spark, d):
    skips = spark.range(1).select(F.explode(F.array(F.lit("Building/"), F.lit(" MACHINERY"))).alias("key"))
    return state.in_skip_list(A.table(spark, d, "customer"), skips, "c_mktsegment").select("c_custkey")


@query(_B + "SELECT key, count(*) AS n, min(bookmark_id) AS first FROM (SELECT bookmark_id, trim(regexp_replace(regexp_replace(lower(trim(title)), '[\\[\\]()\"''“”「」《》]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM bookmarks) WHERE length(key) >= 8 GROUP BY key HAVING count(*) > 1")
def title_dupes(spark, d):
    return dedupe.title_groups(A.bookmarks(spark, d), "title", "bookmark_id")


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def exact_content_dupes(spark, d):
    return dedupe.content_groups(A.table(spark, d, "documents"), "text", "doc_id")


@query(_R + "SELECT slug, rev, sha, content_length FROM revisions r WHERE rev = (SELECT max(rev) FROM revisions s WHERE s.slug = r.slug)")
def revision_latest(spark, d):
    return revisions.latest(A.revisions(spark, d), "slug", order=("fetched_at", "event_id")).select("slug", "rev", "sha", "content_length")


@query(_R + ", m AS (SELECT min(fetched_at) + INTERVAL 10 DAY AS cutoff FROM revisions) SELECT slug, max(rev) AS rev, arg_max(sha, rev) AS sha, max(fetched_at) AS fetched_at FROM revisions, m WHERE fetched_at <= cutoff GROUP BY slug")
def revision_asof(spark, d):
    r = A.revisions(spark, d)
    at = r.agg(F.min("fetched_at").alias("m")).first().m  # one value
    return revisions.as_of(r, F.lit(at).cast("timestamp_ntz") + F.expr("interval 10 days"))


@query(_R + "SELECT slug, rev, sha, before FROM (SELECT slug, rev, sha, lag(sha) OVER (PARTITION BY slug ORDER BY rev) AS before FROM revisions) WHERE before IS NOT NULL AND before <> sha")
def sha_drift_lag(spark, d):
    return audit.sha_drift(A.revisions(spark, d)).select("slug", "rev", "sha", "before")


_UPDATED = ", upd AS (SELECT slug, min(fetched_at) + INTERVAL 5 DAY AS updated FROM revisions GROUP BY slug)"


def _updated(r):
    return r.groupBy("slug").agg((F.min("fetched_at") + F.expr("interval 5 days")).alias("updated"))


@query(
    _R
    + _UPDATED
    + """, dr AS (SELECT slug, rev, sha, lag(sha) OVER (PARTITION BY slug ORDER BY rev) AS before, fetched_at FROM revisions)
    SELECT slug, min(rev) AS rev FROM dr JOIN upd USING (slug) WHERE before IS NOT NULL AND before <> sha AND updated < fetched_at GROUP BY slug"""
)
def audit_first_drift(spark, d):
    r = A.revisions(spark, d)
    return audit.first_drift(r, _updated(r)).select("slug", "rev")


@query(
    _R
    + _UPDATED
    + """, s AS (SELECT slug, arg_max(sha, rev) AS latest, arg_max(sha, rev) FILTER (WHERE fetched_at <= updated) AS known FROM revisions JOIN upd USING (slug) GROUP BY slug)
    SELECT slug, latest, known FROM s WHERE known IS NULL OR known <> latest"""
)
def source_older_than_raw(spark, d):
    r = A.revisions(spark, d)
    return audit.older_than_raw(r, _updated(r))


@query(_R + "SELECT slug, rev FROM (SELECT slug, rev, row_number() OVER (PARTITION BY slug ORDER BY rev DESC) AS k FROM revisions) WHERE k > 5")
def revision_gc_keep_n(spark, d):
    return revisions.plan_gc(A.revisions(spark, d), 5).select("slug", "rev")


@query(
    _R
    + """SELECT slug, rev, delta, regressed FROM (SELECT slug, rev, content_length - lag(content_length) OVER w AS delta, lag(status) OVER w = 'good' AND status <> 'good' AS regressed
    FROM revisions WINDOW w AS (PARTITION BY slug ORDER BY rev)) WHERE delta IS NOT NULL"""
)
def revision_deltas(spark, d):
    return revisions.consecutive_deltas(A.revisions(spark, d)).select("slug", "rev", "delta", "regressed")


@query("SELECT user_id AS slug, event_type AS name, max(event_id) AS last, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY ALL")
def ledger_last_write_wins(spark, d):
    log = A.table(spark, d, "events").select(F.col("user_id").alias("slug"), F.col("event_type").alias("name"), "ts", "event_id", "value")
    last = revisions.latest(log, "slug", "name", order=("ts", "event_id")).select("slug", "name", "value")
    return last.join(log.groupBy("slug", "name").agg(F.max("event_id").alias("last")), ["slug", "name"])


_MATRIX = """WITH loc AS (SELECT l_orderkey AS slug, l_linenumber AS name, l_returnflag AS sha FROM lineitem WHERE l_orderkey % 3 > 0), led AS (SELECT l_orderkey AS slug, l_linenumber AS name, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'x' END AS ledger_sha FROM lineitem WHERE l_orderkey % 4 > 0),
  dis AS (SELECT l_orderkey AS slug, l_linenumber AS name, CASE WHEN l_tax > 0.06 THEN 'delete' ELSE 'keep' END AS decision FROM lineitem WHERE l_discount > 0.08),
  matrix AS (SELECT slug, name, CASE WHEN decision = 'delete' THEN 'delete' WHEN sha IS NULL THEN 'keep-prior' WHEN sha = ledger_sha THEN 'skip' ELSE 'upload' END AS action FROM loc FULL JOIN led USING (slug, name) LEFT JOIN dis USING (slug, name)) """


def _matrix(spark, d):
    li = A.table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "slug", "l_linenumber": "name"})
    local = li.where("slug % 3 > 0").select("slug", "name", F.col("l_returnflag").alias("sha"))
    ledger = li.where("slug % 4 > 0").select("slug", "name", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise("x").alias("sha"))
    dis = li.where("l_discount > 0.08").select("slug", "name", F.when(F.col("l_tax") > 0.06, "delete").otherwise("keep").alias("decision"))
    return revisions.upload_matrix(local, ledger, dis)


@query(_MATRIX + "SELECT action, count(*) AS n, sum(slug) AS slugs FROM matrix GROUP BY action")
def upload_matrix_full_outer(spark, d):
    return _matrix(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.sum("slug").alias("slugs"))


@query(
    _MATRIX
    + """SELECT slug, CASE WHEN bool_or(action = 'delete') THEN 'pending-delete' WHEN bool_or(action = 'upload') AND NOT bool_or(action = 'skip') AND NOT bool_or(action = 'keep-prior') THEN 'unsynced'
    WHEN bool_or(action = 'upload') THEN 'drift' ELSE 'in-sync' END AS state FROM matrix GROUP BY slug"""
)
def backup_status(spark, d):
    return revisions.backup_status(_matrix(spark, d))


@query(
    """SELECT slug, change FROM (SELECT coalesce(d.slug, u.slug) AS slug, CASE WHEN u.slug IS NULL THEN 'create' WHEN d.slug IS NULL THEN 'map-only' WHEN d.sha <> u.content_sha THEN 'update' ELSE 'same' END AS change
    FROM (SELECT doc_id AS slug, sha256(text) AS sha FROM documents WHERE doc_id % 5 > 0) d FULL JOIN (SELECT doc_id AS slug, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(lang) END AS content_sha FROM documents WHERE doc_id % 7 > 0) u ON d.slug = u.slug)"""
)
def sync_changes(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("content"), "lang")
    sha = F.sha2(F.when(F.col("slug") % 2 == 0, F.col("content")).otherwise(F.col("lang")).cast("binary"), 256)
    return revisions.sync_changes(docs.where("slug % 5 > 0"), docs.where("slug % 7 > 0").select("slug", sha.alias("content_sha")))


@query(
    """WITH r AS (SELECT user_id AS slug, min(ts) AS up, max(ts) AS ed FROM events GROUP BY user_id)
    SELECT slug, 'title' AS issue FROM r WHERE slug % 2 = 1 UNION ALL SELECT slug, 'edited' FROM r WHERE ed > up + INTERVAL 5 MINUTE"""
)
def reconcile_skew_all(spark, d):
    e = A.table(spark, d, "events").groupBy(F.col("user_id").alias("slug")).agg(F.min("ts").alias("uploaded_at"), F.max("ts").alias("edited_at"))
    return revisions.reconcile_light(e.withColumn("title", F.when(F.col("slug") % 2 == 1, F.lit(-1)).otherwise(F.col("slug"))))


@query(
    f"""WITH h AS (SELECT regexp_extract({A.sql_part('url', 3)}, '^/([^/]*)', 1) AS key, string_split({A.sql_host('url')}, '.') AS labels FROM pages UNION ALL SELECT array_to_string(list_slice(string_split({A.sql_host('url')}, '.'), -3, -1), '.'), string_split({A.sql_host('url')}, '.') FROM pages),
    k AS (SELECT key, labels, unnest(range(0, 9)) AS n FROM h), s AS (SELECT key, n, count(DISTINCT labels[len(labels) - n + 1:]) AS kinds, min(len(labels)) AS shortest, any_value(array_to_string(labels[len(labels) - n + 1:], '.')) AS suffix FROM k GROUP BY key, n)
    SELECT s.key, CASE WHEN max(n) = 0 THEN '' ELSE arg_max(suffix, n) END AS suffix, any_value(hosts) AS hosts FROM s JOIN (SELECT key, count(DISTINCT labels) AS hosts FROM h GROUP BY key) USING (key) WHERE kinds = 1 AND n <= shortest GROUP BY s.key"""
)
def page_host_suffixes(spark, d):
    """What all hosts share whose URLs begin with the same folder, or whose names end with the same three labels."""
    host = U.hostname_of(F.col("url"))
    keys = F.array(F.regexp_extract(U.part(F.col("url"), 3), "^/([^/]*)", 1), F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 2, F.lit(1)), F.lit(3)), "."))
    return state.host_suffixes(A.table(spark, d, "pages").select(F.explode(keys).alias("key"), host.alias("host")))
