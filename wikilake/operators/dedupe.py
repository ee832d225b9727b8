"""Groups of documents that are the same by title, path, URL or content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.functions import urls as U

MIN_TITLE = 8


def title_key(title: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), r"[\[\]()\"'“”「」《》]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """(key, n, first): values of the key that more than one row has."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


def title_groups(df: DataFrame, title: str, member: str) -> DataFrame:
    key = title_key(F.col(title))
    return groups(df.where(F.length(key) >= MIN_TITLE), key, member)


def mirrored_paths(bookmarks: DataFrame, hosts: tuple[str, str]) -> DataFrame:
    """Paths, without /wiki/ and a query, that both hosts have."""
    path = F.regexp_replace(F.lower(U.part(F.col("link"), 3)), "^/wiki/", "/")
    rows = bookmarks.select(path.alias("path"), U.hostname_of(F.col("link")).alias("host")).where(F.col("host").isin(*hosts))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts")).where("hosts = 2").drop("hosts")


def short_links(bookmarks: DataFrame, short: str, canonical: str) -> DataFrame:
    """Title groups that hold both a short link and its canonical host."""
    rows = bookmarks.select(title_key(F.col("title")).alias("key"), U.hostname_of(F.col("link")).alias("host")).where(F.length("key") >= MIN_TITLE)
    return rows.groupBy("key").agg(F.collect_set("host").alias("hosts")).where(F.array_contains("hosts", short) & F.array_contains("hosts", canonical)).select("key")


def url_groups(bookmarks: DataFrame) -> DataFrame:
    return groups(bookmarks, U.normalize_url(F.col("link")), "bookmark_id")


def content_groups(df: DataFrame, text: str, member: str) -> DataFrame:
    return groups(df.where(F.col(text).isNotNull()), F.sha2(F.col(text).cast("binary"), 256), member)
