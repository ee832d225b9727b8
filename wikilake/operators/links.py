"""Links resolved by a join of their occurrences with a table of slugs, which may be of any size."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.functions import text as T

#: A slug is hot with so many links, or this share of all: at most HOT_SLUGS are.  Their rows go to all tasks if their bytes allow it.
HOT_LINKS, HOT_SLUGS, HOT_BYTES = 1_000, 10_000, 1 << 25


def occurrences(pages: DataFrame) -> DataFrame:
    """(key, place, slug) of each link of pages (key, pieces).  The outer form, as Spark would cut the text again to see that there are pieces."""
    rows = pages.select("key", F.posexplode_outer("pieces").alias("place", "x"))
    return rows.where("x.slug is not null").select("key", "place", "x.slug")


def with_urls(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """links (.., slug) with url, null if the slug isn't in slugs (slug, url), of which the smallest url of a slug counts.  Links to hot slugs
    stay where they are and meet a broadcast of the hot slugs alone; the others are shuffled by slug."""
    known = slugs.where("slug is not null").groupBy("slug").agg(F.min("url").alias("url"))
    counts = links.groupBy("slug").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = known.join(counts.where(F.col("n") > max(HOT_LINKS, total // HOT_SLUGS)).select("slug"), "slug", "right")
    size = hot.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("slug") + F.coalesce(F.octet_length("url"), F.lit(0))), F.lit(0)).alias("b")).first()
    if not size.n or size.b > HOT_BYTES:
        return links.join(known, "slug", "left")
    hot = F.broadcast(hot.select("slug", "url", F.lit(True).alias("hot")))  # at most HOT_SLUGS rows, counted above
    marked = links.join(hot, "slug", "left")
    near = marked.where("hot").drop("hot")
    return near.unionByName(marked.where("hot is null").drop("hot", "url").join(known, "slug", "left"))


def prepared(pages: DataFrame, slugs: DataFrame, missing: str = "placeholder") -> DataFrame:
    """pages (key, raw) as they are sent: (key, text).  The same as functions.text.prepared, with a table (slug, url) in the place of a map.

    Keys name the pages and are not null; rows that share one are one page each only if their texts differ.  The urls of a page come back by the
    places of its links, so a text is shuffled once at most, to meet them; pages without links aren't."""
    keyed = pages.select(F.struct("key", F.xxhash64("raw").alias("version")).alias("key"), "raw")
    linked = F.coalesce(F.contains("raw", F.lit("[[")), F.lit(False))
    pieces = T.link_pieces(T.headless(F.col("raw"))).alias("pieces")
    found = occurrences(keyed.where(linked).select("key", pieces)).dropDuplicates(["key", "place"])  # a page's repeated rows have the same links
    found = found.persist(StorageLevel.DISK_ONLY)  # keys and slugs, counted before they are joined: texts are cut once for it
    resolved = with_urls(found, slugs).where("url is not null")
    urls = resolved.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "url"))).alias("urls"))
    one = lambda x, i: F.when(x.slug.isNull(), x.text).otherwise(F.concat(T.rendered_link(x.slug, x.shown, F.try_element_at("urls", i), missing), x.text))
    joined = keyed.where(linked).join(urls, "key", "left").select("key", "raw", "urls", pieces)
    sent = joined.select("key.key", F.concat(T.frontmatter(F.col("raw")), F.array_join(F.transform("pieces", one), "")).alias("text"))
    plain = keyed.where(~linked).select("key.key", F.concat(T.frontmatter(F.col("raw")), T.headless(F.col("raw"))).alias("text"))
    return sent.unionByName(plain)
