"""Views of the driver's tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikilake.functions import urls as U


#: Rows of an Arrow batch where the session has Spark's default: whole pages are long, and a batch and its elements stand in Python at once.
BATCH_ROWS, _SPARKS_ROWS, _ROWS_KEY = 500, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"
_LONG = frozenset(("documents", "pages", "conversations"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Those of long texts go to Python in batches of BATCH_ROWS, unless the session has a bound of its own."""
    if name in _LONG and spark.conf.get(_ROWS_KEY) == _SPARKS_ROWS:
        spark.conf.set(_ROWS_KEY, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite parts, where they take few of them."""
    return table(spark, d, "lineitem").where("l_quantity <= 5").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def dated_cites(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.to_date("o_orderdate").alias("updated"))
    return cites(spark, d).join(dates, "src")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.when(F.col("p_size") <= 25, "seen").otherwise("active").alias("tier"))


def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select(F.col("page_id").alias("bookmark_id"), F.col("url").alias("link"), title.alias("title"), U.normalize_url(F.col("url")).alias("norm_url"), U.host_of(F.col("url")).alias("host"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    rev = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("value") >= 10, "good").otherwise("flagged")
    return table(spark, d, "events").select(F.col("user_id").alias("slug"), rev.alias("rev"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("sha"), F.floor("value").alias("content_length"), status.alias("status"), "event_id")


CITES = "cites AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity <= 5)"
REFS = "refs AS (SELECT dst, count(*) AS refs FROM cites WHERE src <> dst GROUP BY dst)"
ITEMS = "items AS (SELECT p_partkey AS key, p_name AS name, CASE WHEN p_size <= 25 THEN 'seen' ELSE 'active' END AS tier FROM part)"
REVISIONS = """revisions AS (SELECT user_id AS slug, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev, ts AS fetched_at, event_type AS sha,
  CAST(floor(value) AS BIGINT) AS content_length, CASE WHEN value >= 10 THEN 'good' ELSE 'flagged' END AS status, event_id FROM events)"""
_P = r"'^(?i)(https?)://([^/?#]*)([^?#]*)\??([^#]*)'"


def sql_part(url: str, n: int) -> str:
    return f"regexp_extract(trim({url}), {_P}, {n})"


def sql_host(url: str) -> str:
    """hostname_of."""
    return f"regexp_replace(lower({sql_part(url, 2)}), ':\\d+$', '')"


def sql_norm(url: str) -> str:
    """normalize_url of web addresses."""
    names = ", ".join(f"'{t}'" for t in U.TRACKING)
    path = sql_part(url, 3)
    path = f"(CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END)"
    kept = f"list_filter(string_split({sql_part(url, 4)}, '&'), lambda p: p <> '' AND NOT list_contains([{names}], regexp_extract(p, '^([^=]*)', 1)))"
    placed = f"list_sort(list_transform({kept}, lambda p, i: {{'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': p}}))"
    query = f"array_to_string(list_transform({placed}, lambda s: s.p), '&')"
    return f"concat(lower({sql_part(url, 1)}), '://', lower({sql_part(url, 2)}), {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"


BOOKMARKS = f"""bookmarks AS (SELECT page_id AS bookmark_id, url AS link, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {sql_norm("url")} AS norm_url,
  regexp_replace({sql_host("url")}, '^www\\.', '') AS host FROM pages)"""


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
