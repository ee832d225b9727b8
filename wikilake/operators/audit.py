"""Health checks of entities, sources and their revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikilake.functions import text as T

MIN_SIMILARITY, MIN_NAME = 0.8, 4


def similar_slugs(names: DataFrame) -> DataFrame:
    """(a, b, distance) of distinct names (name) with 1 - distance / longer length of 0.8 or more.

    An exact blocked join: within an edit distance of k, one of k + 1 pieces of the shorter name stands in the
    longer one, moved by k places at most.  The shorter name gives each piece at each of these places, the longer
    one its substrings of the lengths that such pieces have, and the join is by piece and place.  Pairs that both end in a digit
    and agree before it are left out."""
    names = names.select(F.lower("name").alias("name")).distinct().where(F.length("name") >= 1).withColumn("n", F.length("name"))
    # The distance that a pair may have depends on the longer length; each name is cut for all lengths in reach.
    most = lambda n: F.floor(F.floor(n / MIN_SIMILARITY + 1e-9) * (1 - MIN_SIMILARITY) + 1e-9).cast("int")
    k = most(F.col("n"))
    cut = lambda i: F.floor(i * F.col("n") / (k + 1)).cast("int")
    moved = lambda i: F.transform(F.sequence(F.greatest(cut(i) - k, F.lit(0)), cut(i) + k), lambda at: F.struct(at.alias("at"), F.substring("name", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    short = names.select(F.col("name").alias("s"), F.col("n").alias("sn"), F.explode(F.flatten(F.transform(F.sequence(F.lit(0), k), moved))).alias("p")).select("s", "sn", "p.at", "p.piece").where("piece <> ''")
    # Lengths of the pieces of names that this one can be the longer one of.
    sizes = lambda n: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda more: (F.floor(n / (most(n) + 1)) + more).cast("int"))
    widths = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.ceil(F.col("n") * MIN_SIMILARITY - 1e-9).cast("int"), F.lit(1)), F.col("n")), sizes)))
    offered = names.select(F.col("name").alias("l"), F.col("n").alias("ln"), F.explode(widths).alias("w")).where("w between 1 and ln")
    offered = offered.select("l", "ln", F.explode(F.transform(F.sequence(F.lit(0), F.col("ln") - F.col("w")), lambda i: F.struct(i.alias("at"), F.substring("l", i + 1, F.col("w")).alias("piece")))).alias("q")).select("l", "ln", "q.at", "q.piece")
    pairs = short.join(offered, ["piece", "at"]).where((F.col("ln") >= F.col("sn")) & (F.col("ln") * MIN_SIMILARITY <= F.col("sn") + 1e-9) & (F.col("s") != F.col("l")))
    return _near(pairs.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), "ln").distinct())


def _near(pairs: DataFrame) -> DataFrame:
    distance = F.levenshtein("a", "b")
    numbered = F.col("a").rlike("[0-9]$") & F.col("b").rlike("[0-9]$") & (F.expr("left(a, length(a) - 1)") == F.expr("left(b, length(b) - 1)"))
    good = (F.col("ln") >= MIN_NAME) & ~numbered
    return pairs.where(good).withColumn("distance", distance).where(F.col("distance") * 5 <= F.col("ln")).select("a", "b", "distance")


def ranked_duplicates(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """(place, a, b, distance, refs): pairs (a, b, distance) with the citations (name, refs) of both, the most cited first.  Places are
    counted by the numbers of citations, then within each, so no task orders all pairs."""
    of = lambda c: refs.groupBy(F.lower("name").alias(c)).agg(F.sum("refs").alias(f"refs_{c}"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    rows = rows.select("a", "b", "distance", (F.coalesce("refs_a", F.lit(0)) + F.coalesce("refs_b", F.lit(0))).alias("refs"))
    before = Window.orderBy(F.desc("refs")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("refs").agg(F.count("*").alias("n")).select("refs", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("refs").orderBy("a", "b"))
    return rows.withColumn("within", within).join(ahead, "refs").select((F.col("ahead") + F.col("within")).alias("place"), "a", "b", "distance", "refs")


def collisions(names: DataFrame) -> DataFrame:
    """(name, next): neighbours among names that are equal in lower case without punctuation."""
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    w = Window.partitionBy("key").orderBy("name")
    return names.select("name").distinct().withColumn("key", key).withColumn("next", F.lead("name").over(w)).where("next is not null").select("name", "next")


def contradictions(entities: DataFrame) -> DataFrame:
    """The first observation of an entity (slug, body) that retracts something its synthesis doesn't mention."""
    word = r"(?i)\b(retracted|incorrect|superseded|no longer|deprecated|contradicts)\b"
    rows = entities.select("slug", T.section(F.col("body"), "Synthesis").alias("synthesis"), F.posexplode(T.observations(F.col("body"))).alias("pos", "bullet"))
    hits = rows.withColumn("word", F.lower(F.regexp_extract("bullet", word, 1))).where("word <> '' and not contains(lower(coalesce(synthesis, '')), word)")
    return hits.groupBy("slug").agg(F.min_by("bullet", "pos").alias("bullet"), F.min_by("word", "pos").alias("word"))


def sha_drift(revisions: DataFrame, key: str = "slug") -> DataFrame:
    """Revisions (key, rev, sha, fetched_at) whose content differs from the one before."""
    before = F.lag("sha").over(Window.partitionBy(key).orderBy("rev"))
    return revisions.withColumn("before", before).where("before is not null and before <> sha")


def first_drift(revisions: DataFrame, updated: DataFrame, key: str = "slug") -> DataFrame:
    """The first drift of each source (key, updated) after its update."""
    late = sha_drift(revisions, key).join(updated, key).where("updated < fetched_at")
    return late.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("rev"))).where("k = 1").drop("k")


def dead_urls(fetches: DataFrame, pinned: DataFrame) -> DataFrame:
    """Fetches (slug, flags: array) that are flagged as dead and not pinned (slug)."""
    return fetches.where(F.array_contains("flags", "dead-link")).join(pinned, "slug", "left_anti")


def deleted_bookmarks(sources: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Sources (slug, norm_url) whose bookmark (norm_url) is gone; none if there are no bookmarks at all."""
    some = bookmarks.limit(1).select(F.lit(1).alias("some"))
    return sources.join(bookmarks, "norm_url", "left_anti").join(F.broadcast(some)).drop("some")  # one row at most


def head_stale(sources: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Sources (slug, updated, checked) not looked at for so many days, either way."""
    old = lambda c: F.datediff(F.to_date(F.lit(as_of)), F.col(c)) > days
    return sources.where(old("updated") & (F.col("checked").isNull() | old("checked")))


def older_than_raw(revisions: DataFrame, updated: DataFrame, key: str = "slug") -> DataFrame:
    """As-of join: sources (key, updated) whose last revision at or before the update isn't the latest content."""
    at = F.col("fetched_at") <= F.col("updated")
    seen = revisions.join(updated, key).groupBy(key).agg(F.max_by("sha", "rev").alias("latest"), F.max_by(F.when(at, F.col("sha")), F.when(at, F.col("rev"))).alias("known"))
    return seen.where("known is null or known <> latest")


def zero_links(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("links") == 0)


def tag_outliers(pages: DataFrame) -> DataFrame:
    """Pages (slug, tags) each of whose tags no other page has."""
    rows = pages.select("slug", F.explode("tags").alias("tag"))
    use = rows.groupBy("tag").agg(F.count_distinct("slug").alias("n"))
    return rows.join(use, "tag").groupBy("slug").agg(F.bool_and(F.col("n") == 1).alias("alone")).where("alone").select("slug")


def age_stale(pages: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    return pages.where(F.datediff(F.to_date(F.lit(as_of)), F.col("updated")) > days)


def topic_only(cites: DataFrame, bucket: DataFrame) -> DataFrame:
    """Cited slugs (dst) that topics cite and entities don't (bucket: src, bucket)."""
    known = cites.join(bucket, "src")
    by = lambda b: known.where(F.col("bucket") == b).select("dst").distinct()
    return by("01_Topics").join(by("02_Entities"), "dst", "left_anti")


def stale_strict(items: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """Items (key, synthesised: date) older than their newest citing source (key, newest: date), by any number of days."""
    return items.join(newest, key).where(F.col("newest") > F.col("synthesised")).select(key, F.datediff("newest", "synthesised").alias("days"))
