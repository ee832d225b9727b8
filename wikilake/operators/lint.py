"""Checks over a wiki.  Each returns (kind, severity, path, detail); `run` unions the wanted ones lazily."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.functions import text as T
from wikilake.operators import graph

# The required keys of a page's frontmatter, and thresholds of the checks.
REQUIRED = {"03_Sources": ("type", "created", "updated", "source_url", "tags"), "02_Entities": ("type", "created", "updated", "refs", "tier"), "01_Topics": ("type", "created", "updated", "source_count"), "00_Meta": ("type", "created", "updated")}
LAG_DAYS, AGE_DAYS, MIN_OBSERVATIONS, REVIEW_DAYS = 7, 30, 3, 30
MIN_IMAGE_BYTES = 512


def issue(df: DataFrame, kind: str, severity: str | Column, path: str | Column, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    path = F.col(path) if isinstance(path, str) else path
    return df.select(F.lit(kind).alias("kind"), severity.alias("severity"), path.cast("string").alias("path"), detail.cast("string").alias("detail"))


def orphans(items: DataFrame, cites: DataFrame, key: str) -> DataFrame:
    """Items that no page cites."""
    cited = cites.where("src <> dst").select(F.col("dst").alias(key))
    return issue(items.join(cited, key, "left_anti"), "orphans", "warn", key, F.lit("refs 0"))


def dead_links(cites: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Links to slugs that don't exist."""
    return issue(cites.join(items.select(F.col(key).alias("dst")), "dst", "left_anti"), "dead-wikilinks", "error", "src", F.col("dst"))


def tier_mismatch(items: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Items (key, tier, refs) whose tier doesn't fit their refs."""
    high, low = (F.col("tier") == "seen") & (F.col("refs") >= least), (F.col("tier") == "active") & (F.col("refs") < least)
    return issue(items.where(high | low), "tier-mismatch", F.when(high, "error").otherwise("warn"), key, F.concat_ws(":", "tier", "refs"))


def missing_keys(pages: DataFrame) -> DataFrame:
    """Required keys that are absent from a page (path, bucket, keys: array)."""
    wanted = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in REQUIRED.items() for x in (k, v)))
    gaps = pages.withColumn("gap", F.explode(F.array_except(F.coalesce(wanted[F.col("bucket")], F.array().cast("array<string>")), "keys")))
    return issue(gaps, "frontmatter", "error", "path", F.col("gap"))


def raw_orphans(sources: DataFrame, raw: DataFrame) -> DataFrame:
    """Sources (slug) without raw content, and raw content (slug, quality) without a source, unless it is known to be bad."""
    both = sources.withColumn("s", F.lit(1)).join(raw.withColumn("r", F.lit(1)), "slug", "full")
    lone = both.where("s is null or r is null").where("s is not null or coalesce(quality, 'good') = 'good'")
    return issue(lone, "raw-orphan", F.when(F.col("r").isNull(), "error").otherwise("info"), "slug", F.when(F.col("r").isNull(), "no raw content").otherwise("no source"))


def sources_index(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (url, repo_path) without a path, or whose file isn't there (files: repo_path)."""
    lost = entries.join(files.withColumn("there", F.lit(1)), "repo_path", "left").where("there is null")
    return issue(lost, "sources-index", F.when(F.col("repo_path").isNull(), "error").otherwise("warn"), "url", F.coalesce("repo_path", F.lit("no path")))


def image_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Local references (path, ref) to missing, small or non-image files (ref, bytes, is_image)."""
    got = refs.join(files, "ref", "left")
    why = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < MIN_IMAGE_BYTES, "small").when(~F.col("is_image"), "no image")
    return issue(got.withColumn("why", why).where("why is not null"), "source-image-refs", "error", "path", F.concat_ws(":", "ref", "why"))


def image_count(sources: DataFrame) -> DataFrame:
    """Sources (path, raw_images, raw_svgs, raw_bytes, raw_chars, refs, declined) that should show images and don't, or show too many."""
    n, chars = F.col("raw_images"), F.col("raw_chars")
    why = F.array_compact(F.array(F.when(F.col("raw_svgs") > 0, "svg"), F.when(F.col("raw_bytes") >= 100_000, "large"), F.when(n >= 3, "many"), F.when((n > 0) & (chars < 500), "thin"), F.when((n > 0) & (chars / F.greatest(n, F.lit(1)) < 200), "dense")))
    few = (F.size(why) > 0) & (F.col("refs") < F.least(F.lit(2), n)) & ~F.col("declined")
    bad = sources.where(few | (F.col("refs") > 5))
    return issue(bad, "source-image-count", "warn", "path", F.when(few, F.array_join(why, ",")).otherwise("too many"))


def unknown_tags(pages: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Pages (path, tags: array) with tags outside the vocabulary, one issue a page."""
    odd = F.array_sort(F.array_except("tags", F.array(*map(F.lit, vocabulary))))
    return issue(pages.withColumn("odd", odd).where("size(odd) > 0"), "tag-vocabulary", "warn", "path", F.array_join("odd", ","))


def topic_content_gaps(topics: DataFrame) -> DataFrame:
    """Topics (path, source_count, body) with three sources or more and only stubs to say."""
    stub = T.is_stub(T.section(F.col("body"), "What")) & T.is_stub(T.section(F.col("body"), "Current understanding"))
    return issue(topics.where((F.col("source_count") >= 3) & stub), "topic-content-gaps", "warn", "path", F.col("source_count"))


def comparison_table_missing(topics: DataFrame) -> DataFrame:
    rows = F.size(F.filter(T.lines(F.coalesce(T.section(F.col("body"), "Comparison"), F.lit(""))), lambda x: x.startswith("|")))
    return issue(topics.where(T.section(F.col("body"), "Comparison").isNotNull() & (rows < 3)), "comparison-table-missing", "warn", "path", rows)


# Contrasts, the mark of a stub, how many entities, and how long a bare name is at least.
CONTRAST = r"(?i)\bvs\b|\bcompared to\b|\btradeoff\b|\bdiffers from\b|\bversus\b|\bvs\.\b"
STUB_MARK, COMPARED, NAME_CHARS = "_(stub —", 3, 3


def comparison_opportunity(topics: DataFrame, entities: DataFrame) -> DataFrame:
    """Topics (path, body) without a comparison whose understanding draws contrasts and which name three active entities (name) or more: by
    links anywhere, or by bare names of one word or several in their understanding."""
    said = T.section(F.col("body"), "Current understanding")
    open_ = topics.where(~F.col("body").rlike(r"(?md)^ *## Comparison *\r?$")).select("path", "body", said.alias("said"))
    open_ = open_.where((F.trim("said") != "") & ~F.contains("said", F.lit(STUB_MARK)) & F.col("said").rlike(CONTRAST))
    linked = open_.select("path", F.explode(T.wikilinks(F.col("body"))).alias("name")).join(entities.select("name").distinct(), "name", "left_semi")
    named = graph.named_mentions(open_.select(F.col("path").alias("text_id"), F.col("said").alias("text")), entities.where(F.length("name") >= NAME_CHARS))
    n = linked.select("path", "name").unionByName(named.select(F.col("text_id").alias("path"), "name")).groupBy("path").agg(F.count_distinct("name").alias("n"))
    return issue(n.where(F.col("n") >= COMPARED), "comparison-opportunity", "info", "path", F.col("n"))


def stale_synthesis(items: DataFrame, newest: DataFrame, as_of: str | Column, key: str, kind: str = "stale-synthesis") -> DataFrame:
    """Items (key, synthesised: date, observations) behind their newest citing source (key, newest: date) by a week, or
    old and with observations to take in.  The first reason counts."""
    as_of = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    lag, age = F.datediff("newest", "synthesised"), F.datediff(as_of, F.col("synthesised"))
    why = F.when(lag > LAG_DAYS, F.concat(F.lit("lag "), lag)).when((age > AGE_DAYS) & (F.col("observations") >= MIN_OBSERVATIONS), F.concat(F.lit("age "), age))
    return issue(items.join(newest, key, "left").withColumn("why", why).where("why is not null"), kind, "warn", key, F.col("why"))


def stale_topics(topics: DataFrame, newest: DataFrame, as_of: str | Column, key: str) -> DataFrame:
    """stale_synthesis for topics, whose open threads count as observations."""
    return stale_synthesis(topics, newest, as_of, key, "stale-topic-synthesis")


def observation_gaps(gaps: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Gaps (dst, n_citing, n_missing) of active items (key, tier)."""
    active = items.where("tier = 'active'").select(F.col(key).alias("dst"))
    return issue(gaps.join(active, "dst", "left_semi"), "observation-gaps", "warn", "dst", F.col("n_missing"))


def stale_review(sources: DataFrame, fetches: DataFrame, key: str) -> DataFrame:
    """Sources (key, reviewed: date) fetched again (key, fetched: date) more than a month after their review."""
    last = fetches.groupBy(key).agg(F.max("fetched").alias("last"))
    late = sources.join(last, key).where(F.datediff("last", "reviewed") > REVIEW_DAYS)
    return issue(late, "stale-source-review", "warn", key, F.datediff("last", "reviewed"))


def stale_top(page: DataFrame, topics: DataFrame) -> DataFrame:
    """The root page (path, updated) older than the newest topic (slug, updated) by more than a week."""
    newest = topics.agg(F.max("updated").alias("newest"), F.max_by("slug", F.struct("updated", "slug")).alias("slug"))
    return issue(page.crossJoin(F.broadcast(newest)).where(F.datediff("newest", "updated") > LAG_DAYS), "stale-top-synthesis", "warn", "path", F.col("slug"))  # one row on either side


def curation_needed(issues: DataFrame, least: int = 5) -> DataFrame:
    """One line if stale, orphaned and mis-tiered items are many."""
    n = issues.agg(F.count_if(F.col("kind").isin("stale-synthesis", "orphans", "tier-mismatch")).alias("n"))
    return issue(n.where(F.col("n") >= least), "curation-needed", "info", F.lit("."), F.col("n"))


def run(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
