"""Pipeline state, status rows and plans: joins of bookmarks, raw content and the ingested index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikilake.functions import elements as E
from wikilake.functions import urls as U
from wikilake.operators.quality import kind_order

STATES = ("ingested", "not-yet-good", "ingest-ready")


def first_by(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def build_index(pages: DataFrame) -> DataFrame:
    """(norm_url, slug, repo_path, n): the first page, by path, of each normalised source_url, and how many have it."""
    keyed = pages.withColumn("norm_url", U.normalize_url(F.col("source_url")))
    return keyed.groupBy("norm_url").agg(F.min_by("slug", "repo_path").alias("slug"), F.min("repo_path").alias("repo_path"), F.count("*").alias("n"))


def ingested_urls(index: DataFrame) -> DataFrame:
    """Distinct keys, and what share links among them lead to."""
    both = F.array("norm_url", U.normalize_url(U.unwrap_share_url(F.col("norm_url"))))
    return index.select(F.explode(both).alias("norm_url")).distinct()


def pipeline_state(quality: Column, ingested: Column) -> Column:
    """ingested beats not-yet-good beats ingest-ready."""
    return F.when(ingested, STATES[0]).when(F.coalesce(quality, F.lit("failed")) != "good", STATES[1]).otherwise(STATES[2])


def raw_index(raw: DataFrame, bookmarks: DataFrame, ingested: DataFrame) -> DataFrame:
    """raw (slug, link, quality) with its bookmark (norm_url, bookmark_id) by the link or what it leads to, and its state."""
    keyed = raw.withColumn("norm_url", U.normalize_url(F.col("link"))).withColumn("target", U.normalize_url(U.unwrap_share_url(F.col("link"))))
    marks = bookmarks.groupBy("norm_url").agg(F.min("bookmark_id").alias("bookmark_id"))
    out = keyed.join(marks, "norm_url", "left").join(marks.select(F.col("norm_url").alias("target"), F.col("bookmark_id").alias("by_target")), "target", "left")
    out = out.withColumn("bookmark_id", F.coalesce("bookmark_id", "by_target")).drop("by_target")
    hit = lambda c: ingested.select(F.col("norm_url").alias(c), F.lit(True).alias(f"in_{c}"))
    out = out.join(hit("norm_url"), "norm_url", "left").join(hit("target"), "target", "left")
    done = F.coalesce("in_norm_url", "in_target", F.lit(False))
    return out.withColumn("state", pipeline_state(F.col("quality"), done)).drop("in_norm_url", "in_target")


def status_rows(bookmarks: DataFrame, raw: DataFrame) -> DataFrame:
    """Bookmarks (bookmark_id, norm_url) with their raw content (norm_url, slug, kind), and raw content without one."""
    left = bookmarks.join(raw, "norm_url", "left").select("bookmark_id", "norm_url", "slug", F.coalesce("kind", F.lit("not-yet-fetched")).alias("kind"))
    lone = raw.join(bookmarks, "norm_url", "left_anti").select(F.lit(None).cast("long").alias("bookmark_id"), "norm_url", "slug", "kind")
    return left.unionByName(lone)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(kind_order(F.col("kind")), U.hostname_of(F.col("norm_url")), "norm_url")


def by_kind(rows: DataFrame) -> DataFrame:
    """Counts by kind below counts by group (clean, content, upstream, ...), and the total."""
    group = F.regexp_extract("kind", "^([a-z]+)", 1)
    return rows.withColumn("group", group).rollup("group", "kind").agg(F.count("*").alias("n"))


def host_report(bookmarks: DataFrame) -> DataFrame:
    """(host, bookmarks, urls, uncovered): hosts with more than one bookmark are worth a module."""
    return bookmarks.groupBy("host").agg(F.count("*").alias("bookmarks"), F.count_distinct("norm_url").alias("urls")).withColumn("uncovered", F.col("bookmarks") > 1)


def graduations(now: DataFrame, before: DataFrame) -> DataFrame:
    """(host, n, change): graduated from one bookmark, new with several, or a new single one."""
    both = now.join(before.select("host", F.col("n").alias("was")), "host", "left")
    change = F.when((F.col("was") == 1) & (F.col("n") >= 2), "graduated").when(F.col("was").isNull() & (F.col("n") >= 2), "brand-new").when(F.col("was").isNull(), "new-singleton")
    return both.withColumn("change", change).where("change is not null").select("host", "n", "change")


def running_limit(rows: DataFrame, counts: Column, most: int, *order: str) -> DataFrame:
    """Rows up to the point where `most` of those that count have come; the others don't use the limit up.  order: columns
    that tell all rows apart, the last first where a minus stands before the name.

    What is kept stands before the counting row number most + 1: a top-k finds that row, a plain filter does the rest,
    so no task numbers all rows."""
    keys = [(x.lstrip("-"), x.startswith("-")) for x in order]
    by = lambda turned: [F.desc(k) if down != turned else F.asc(k) for k, down in keys]
    first = rows.where(counts).orderBy(*by(False)).limit(most + 1).select(*(k for k, _ in keys))
    ends = first.withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.col("_n") > most)  # at most `most` + 1 rows
    end = ends.orderBy(*by(True)).drop("_n").first()
    if end is None:
        return rows
    before, same = F.lit(False), F.lit(True)
    for k, down in keys:
        at = F.lit(end[k])
        before, same = before | (same & (F.col(k) > at if down else F.col(k) < at)), same & (F.col(k) == at)
    return rows.where(before)


def fetch_plan(bookmarks: DataFrame, raw: DataFrame, skipped: DataFrame, limit: int | None = None) -> DataFrame:
    """(bookmark_id, norm_url, slug, action): one bookmark, the oldest, for each URL; colliding slugs get the id; newest first."""
    one = bookmarks.groupBy("norm_url").agg(F.min("bookmark_id").alias("bookmark_id"), F.min_by("slug", "bookmark_id").alias("slug"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("bookmark_id"))
    one = one.withColumn("slug", F.when(place > 1, F.concat_ws("-", "slug", "bookmark_id")).otherwise(F.col("slug")))
    got = raw.select("norm_url", "quality").dropDuplicates(["norm_url"])
    out = one.join(got, "norm_url", "left").join(skipped.select("norm_url", F.lit(1).alias("skip")).distinct(), "norm_url", "left")
    action = F.when(F.col("skip") == 1, "skip").when(F.col("quality") == "good", "keep").when(F.col("quality").isNotNull(), "retry").otherwise("fetch")
    out = out.withColumn("action", action).select("bookmark_id", "norm_url", "slug", "action")
    return out if limit is None else running_limit(out, F.col("action") == "fetch", limit, "-bookmark_id")


def sync_action(row: dict[str, Column]) -> Column:
    """The ordered cascade of a sync: frozen, excluded, decided, pinned, missing, to retry, aged, checked, or kept.
    row: boolean columns of these names, false where nothing is known."""
    out = F.lit("keep")
    for name, action in (("checked", "head-check"), ("aged", "refresh"), ("retry", "retry"), ("missing", "fetch"), ("pinned", "skip-pinned"), ("decided", "skip-decided"), ("excluded", "skip-host"), ("frozen", "skip-frozen")):
        if name in row:
            out = F.when(F.coalesce(row[name], F.lit(False)), action).otherwise(out)
    return out


def head_check(old_tag: Column, new_tag: Column, old_modified: Column, new_modified: Column) -> Column:
    """Whether the source has changed, by its tag, else by its date; unknown without either."""
    return F.when(old_tag.isNotNull() & new_tag.isNotNull(), F.when(old_tag == new_tag, "same").otherwise("changed")).when(old_modified.isNotNull() & new_modified.isNotNull(), F.when(old_modified == new_modified, "same").otherwise("changed")).otherwise("unknown")


def new_bookmarks(bookmarks: DataFrame, ingested: DataFrame) -> DataFrame:
    return bookmarks.join(ingested, "norm_url", "left_anti")


def ingest_candidates(raw: DataFrame, ingested_slugs: DataFrame, ingested: DataFrame, excluded: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Good raw content (slug, norm_url, host, quality, created) not ingested under its slug or URL, nor from an excluded host
    (suffix) or its subdomains; oldest first."""
    out = raw.where("quality = 'good' and norm_url is not null and host <> ''").join(ingested_slugs, "slug", "left_anti").join(ingested, "norm_url", "left_anti")
    if excluded is not None:  # every suffix of a host is a key, so this is an equality join
        parts = F.split("host", r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        hosts = out.select("host").distinct().select("host", F.explode(tails).alias("suffix")).join(excluded.select("suffix"), "suffix", "left_semi")
        out = out.join(hosts.select("host").distinct(), "host", "left_anti")
    return out if limit is None else out.orderBy("created", "slug").limit(limit)


def queue_fold(events: DataFrame) -> DataFrame:
    """(id, status): the last event (id, status, at, seq) of each queue entry."""
    return events.groupBy("id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"))


def skip_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def in_skip_list(rows: DataFrame, skips: DataFrame, column: str) -> DataFrame:
    """Rows whose column stands in the list (key), without regard to case and a last slash."""
    keys = skips.select(skip_key(F.col("key")).alias("_k")).distinct()
    return rows.withColumn("_k", skip_key(F.col(column))).join(keys, "_k", "left_semi").drop("_k")


def identifier_kind(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), "id").when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "url").otherwise("slug")


def needs_rebuild(files: DataFrame, built: Column) -> DataFrame:
    """(rebuild, n_newer): whether any file (modified) is newer than the index; also if there is no index."""
    newer = F.count_if(F.col("modified") > built)
    return files.agg(F.coalesce((newer > 0) | F.max(built).isNull(), F.lit(True)).alias("rebuild"), newer.alias("n_newer"))


def resolved_identifiers(asked: DataFrame, bookmarks: DataFrame, raw: DataFrame) -> DataFrame:
    """asked (identifier) with kind, url and slug: a bookmark's number (bookmark_id, link, slug), a URL, or the slug of raw content (slug, link)."""
    name = F.regexp_replace("identifier", "^raindrop:", "")
    rows = asked.withColumn("_name", name).withColumn("kind", identifier_kind(name))
    marks = bookmarks.select(F.col("bookmark_id").cast("string").alias("_name"), F.col("link").alias("_mark"), F.col("slug").alias("_mark_slug"))
    kept = raw.select(F.col("slug").alias("_name"), F.col("link").alias("_raw"))
    rows = rows.join(marks, "_name", "left").join(kept, "_name", "left")
    by = lambda a, b, c: F.when(F.col("kind") == "id", a).when(F.col("kind") == "url", b).otherwise(c)
    return rows.select("identifier", "kind", by(F.col("_mark"), F.col("_name"), F.col("_raw")).alias("url"), by(F.col("_mark_slug"), F.lit(None), F.col("_name")).alias("slug"))


def forget_plan(targets: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, branch, slug, skip_key) of targets (target: a slug or a URL), by what exists of it: raw content (slug, url) and a source (slug)."""
    is_url = F.col("target").rlike("(?i)^https?://")
    by_url = raw.select(F.lower("url").alias("_u"), F.col("slug").alias("_slug_u"))
    by_slug = raw.select(F.col("slug").alias("target"), F.col("url").alias("_url"))
    rows = targets.withColumn("_u", F.when(is_url, F.lower("target"))).join(by_url, "_u", "left").join(by_slug, "target", "left")
    rows = rows.withColumn("slug", F.when(is_url, F.col("_slug_u")).otherwise(F.col("target"))).withColumn("_raw", F.col("_slug_u").isNotNull() | F.col("_url").isNotNull())
    rows = rows.join(sources.select("slug", F.lit(True).alias("_source")), "slug", "left")
    branch = F.when(F.col("_raw") & F.col("_source").isNotNull(), "source-and-raw").when(F.col("_raw"), "raw-only").otherwise("neither")
    return rows.select("target", branch.alias("branch"), "slug", F.coalesce(F.when(is_url, F.col("target")), F.col("_url"), F.col("target")).alias("skip_key"))


def host_suffixes(hosts: DataFrame) -> DataFrame:
    """(key, suffix, hosts): the longest suffix, by labels, that all hosts (key, host) of a key share, and how many there are.  The smallest and the
    largest of the reversed labels share no more than all do, so nothing is gathered."""
    labels = F.reverse(F.split("host", r"\."))
    rows = hosts.where("host is not null").groupBy("key").agg(F.min(labels).alias("low"), F.max(labels).alias("high"), F.count_distinct("host").alias("hosts"))
    return rows.select("key", F.array_join(F.reverse(E.shared_prefix(F.col("low"), F.col("high"))), ".").alias("suffix"), "hosts")
