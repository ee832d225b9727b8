"""Citation graph: edges (src, dst) are distinct pages and the slugs they link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.functions import text as T

PROMOTE_AT = 3


def edges(docs: DataFrame, links: Column) -> DataFrame:
    """Distinct (src, src_bucket, dst) of pages (slug, bucket) and their array of links."""
    return docs.select(F.col("slug").alias("src"), F.col("bucket").alias("src_bucket"), F.explode(links).alias("dst")).distinct()


def count_refs(cites: DataFrame) -> DataFrame:
    """(dst, refs): distinct citing pages without the page itself; targets need not exist."""
    return cites.where("src <> dst").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("refs"))


def tier(refs: Column) -> Column:
    return F.when(refs >= PROMOTE_AT, "active").otherwise("seen")


def with_refs(items: DataFrame, cites: DataFrame, key: str) -> DataFrame:
    """items with refs, 0 for uncited ones."""
    refs = count_refs(cites).withColumnRenamed("dst", key)
    return items.join(refs, key, "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def source_counts(cites: DataFrame, sources: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, n_sources): distinct sources linked with a topic in either direction.  sources has src, topics topic."""
    there = cites.select(F.col("src").alias("source"), F.col("dst").alias("topic"))
    back = cites.select(F.col("dst").alias("source"), F.col("src").alias("topic"))
    both = there.unionByName(back).distinct()
    both = both.join(sources.select(F.col("src").alias("source")), "source", "left_semi").join(topics, "topic", "left_semi")
    return both.groupBy("topic").agg(F.count("*").alias("n_sources"))


def citations_of(cites: DataFrame) -> DataFrame:
    """(dst, citing): sorted array of citing pages."""
    return cites.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("citing"))


def observation_gaps(cites: DataFrame, observed: DataFrame) -> DataFrame:
    """(dst, n_citing, n_missing): citing sources that the target's observations don't name."""
    missing = cites.join(observed.withColumn("seen", F.lit(1)), ["src", "dst"], "left")
    out = missing.groupBy("dst").agg(F.count("*").alias("n_citing"), F.count_if(F.col("seen").isNull()).alias("n_missing"))
    return out.where("n_missing > 0")


def plan_updates(items: DataFrame) -> DataFrame:
    """Changes for items (key, stored_refs, stored_tier, refs): new counts, and promotion; never a demotion."""
    promote = (F.col("stored_tier") == "seen") & (F.col("refs") >= PROMOTE_AT)
    change = promote | (F.col("refs") != F.col("stored_refs"))
    return items.where(change).withColumn("new_tier", F.when(promote, "active").otherwise(F.col("stored_tier")))


def slug_collisions(docs: DataFrame) -> DataFrame:
    """Slugs with more than one page, and the bucket that wins: that of the last path."""
    return docs.groupBy("slug").agg(F.count("*").alias("pages"), F.max_by("bucket", "repo_path").alias("bucket")).where("pages > 1")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name): names (name) of one word that stand in a text (text_id, text) as a whole word."""
    words = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1)))).alias("name"))
    return words.join(names, "name", "left_semi")


TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9]"
#: Names may be broadcast up to so many rows and bytes; more are joined by a shuffle on their first token.
SMALL_ROWS, SMALL_BYTES = 100_000, 1 << 25


def named_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, place, name): where names (name) of any number of words stand in texts (text_id, text), with no ASCII letter or digit beside
    them.  Mentions of a text don't overlap: from left to right, the longest at each place.  place counts tokens from 0.

    Texts and names are cut into the same tokens, so a name stands where its tokens do.  Candidates are found by an equality join on
    the first token, with as many tokens behind it as the longest name has; a text's hits are gathered, never its candidates."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    known = names.select("name").where("name <> ''").distinct().select("name", tokens(F.col("name")).alias("own")).withColumn("first", F.col("own")[0])
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(2 * F.octet_length("name")), F.lit(0)).alias("b"), F.coalesce(F.max(F.size("own")), F.lit(0)).alias("longest")).first()
    if size.n <= SMALL_ROWS and size.b <= SMALL_BYTES:
        known = F.broadcast(known)
    wide = lambda t, i: F.struct(i.alias("place"), t.alias("first"), F.get(F.col("cut"), i - 1).alias("before"), F.slice(F.col("cut"), i + 1, size.longest + 1).alias("rest"))
    cut = texts.select("text_id", tokens(F.col("text")).alias("cut"))
    places = cut.select("text_id", F.explode(F.filter(F.transform("cut", wide), lambda x: ~x["first"].rlike(r"^\s$"))).alias("x")).select("text_id", "x.*")
    word = lambda t: F.coalesce(t.rlike("^[A-Za-z0-9]"), F.lit(False))
    n = F.size("own")
    # beside a token of letters stands none, so only a name that begins or ends with another sign needs a look
    apart = (word(F.col("first")) | ~word(F.col("before"))) & (word(F.element_at("own", -1)) | ~word(F.get(F.col("rest"), n)))
    hits = places.join(known, "first").where((F.slice("rest", F.lit(1), n) == F.col("own")) & apart)
    gathered = hits.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("place", (-n).alias("back"), "name"))).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<place:int,name:string>>").alias("kept"))
    step = lambda a, h: F.when(h.place >= a.free, F.struct((h.place - h.back).alias("free"), F.array_append(a.kept, F.struct(h.place.alias("place"), h["name"].alias("name"))).alias("kept"))).otherwise(a)
    return gathered.select("text_id", F.explode(F.aggregate("hits", start, step, lambda a: a.kept)).alias("m")).select("text_id", "m.place", "m.name")


def citation_index(docs: DataFrame) -> DataFrame:
    """(dst, path, line, link): every wikilink outside fences of pages (repo_path, bucket, body), repeated ones too, with its line in the
    body; generated pages (00_Meta) are left out."""
    rows = docs.where("bucket <> '00_Meta'").select(F.col("repo_path").alias("path"), F.explode(T.link_places(F.col("body"))).alias("x"))
    return rows.select(F.col("x.target").alias("dst"), "path", "x.line", "x.link")


def plan_topic_updates(topics: DataFrame) -> DataFrame:
    """Topics (key, stored, n_sources) whose stored count of sources differs."""
    return topics.where(~F.col("stored").eqNullSafe(F.col("n_sources")))
