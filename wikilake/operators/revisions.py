"""Revision logs, ledgers and backups: last write wins, as-of look-ups, drift, garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikilake.functions import text as T


def latest(log: DataFrame, *keys: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key; ties of the order must be broken by its last column."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return log.withColumn("_k", last).where("_k = 1").drop("_k")


def valid_prefix(log: DataFrame, file: str = "file", line: str = "line", corrupt: str = "corrupt") -> DataFrame:
    """Rows of each file before its first corrupt line."""
    first = F.min(F.when(F.col(corrupt), F.col(line))).over(Window.partitionBy(file))
    return log.withColumn("_f", first).where(F.col("_f").isNull() | (F.col(line) < F.col("_f"))).drop("_f")


def repaired(log: DataFrame, corrupt: str = "corrupt") -> tuple[DataFrame, DataFrame]:
    """The readable rows, and how many were kept and dropped."""
    return log.where(~F.col(corrupt)), log.agg(F.count_if(~F.col(corrupt)).alias("kept"), F.count_if(corrupt).alias("dropped"))


def next_rev(revisions: DataFrame, key: str = "slug") -> DataFrame:
    return revisions.groupBy(key).agg((F.coalesce(F.max("rev"), F.lit(0)) + 1).alias("next_rev"))


def backfilled(revisions: DataFrame, records: DataFrame, key: str = "slug") -> DataFrame:
    """revisions, with revision 1 made from the record of each key that has none."""
    first = records.join(revisions.select(key).distinct(), key, "left_anti").withColumn("rev", F.lit(1))
    return revisions.unionByName(first, allowMissingColumns=True)


def as_of(revisions: DataFrame, at: Column, key: str = "slug") -> DataFrame:
    """The last revision of each key fetched by then."""
    seen = revisions.where(F.col("fetched_at") <= at)
    return seen.groupBy(key).agg(F.max("rev").alias("rev"), F.max_by("sha", "rev").alias("sha"), F.max_by("fetched_at", "rev").alias("fetched_at"))


def consecutive_deltas(revisions: DataFrame, key: str = "slug") -> DataFrame:
    """Each revision's change of length to the one before, and whether good turned into something else."""
    w = Window.partitionBy(key).orderBy("rev")
    before, was = F.lag("content_length").over(w), F.lag("status").over(w)
    return revisions.withColumn("delta", F.col("content_length") - before).withColumn("regressed", (was == "good") & (F.col("status") != "good")).where("delta is not null")


def structural_delta(pair: DataFrame, old: str, new: str) -> DataFrame:
    """Differences of five counters of two texts in a row."""
    a, b = T.structure(F.col(old)), T.structure(F.col(new))
    return pair.select("*", *((b[k] - a[k]).alias(f"d_{k}") for k in a))


def age_text(days: Column) -> Column:
    unit = lambda n, one: F.concat(F.round(n).cast("long").cast("string"), F.lit(f" {one}"))
    return F.when(days < 60, unit(days, "days")).when(days < 730, unit(days / 30, "months")).otherwise(unit(days / 365, "years"))


def plan_gc(revisions: DataFrame, keep: int, key: str = "slug") -> DataFrame:
    """Revisions beyond the newest `keep` of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rev")))
    return revisions.withColumn("place", place).where(F.col("place") > keep).drop("place")


def mark_pruned(revisions: DataFrame, pruned: DataFrame, key: str = "slug") -> DataFrame:
    return revisions.join(pruned.select(key, "rev", F.lit(True).alias("body_pruned")), [key, "rev"], "left").withColumn("body_pruned", F.coalesce("body_pruned", F.lit(False)))


def upload_matrix(local: DataFrame, ledger: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(slug, name, action) over local files (slug, name, sha), uploaded ones and last dispositions (slug, name, decision)."""
    there = ledger.select("slug", "name", F.col("sha").alias("ledger_sha"))
    rows = local.join(there, ["slug", "name"], "full").join(dispositions, ["slug", "name"], "left")
    action = F.when(F.col("decision") == "delete", "delete").when(F.col("sha").isNull(), "keep-prior").when(F.col("sha") == F.col("ledger_sha"), "skip").otherwise("upload")
    return rows.select("slug", "name", action.alias("action"))


def backup_status(matrix: DataFrame) -> DataFrame:
    """(slug, state) of an upload matrix: pending-delete beats unsynced or drift beats in-sync."""
    has = lambda a: F.bool_or(F.col("action") == a)
    state = F.when(has("delete"), "pending-delete").when(has("upload") & ~has("skip") & ~has("keep-prior"), "unsynced").when(has("upload"), "drift").otherwise("in-sync")
    return matrix.groupBy("slug").agg(state.alias("state"))


def restore_plan(remote: DataFrame, dispositions: DataFrame, local: DataFrame) -> DataFrame:
    gone = dispositions.where("decision = 'delete'").select("slug", "name")
    return remote.join(gone, ["slug", "name"], "left_anti").join(local.select("slug", "name"), ["slug", "name"], "left_anti")


def slug_collisions(docs: DataFrame) -> DataFrame:
    """(slug, first, last): slugs that pages (slug, path) of different paths share."""
    paths = docs.groupBy("slug").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    return paths.where(F.col("first") != F.col("last"))


def sync_changes(docs: DataFrame, uploaded: DataFrame) -> DataFrame:
    """(slug, change): to create, to update (by the content's sha-256), or only on the other side.  If docs has a path, pages that share a
    slug are an error, since one would overwrite the other."""
    if "path" in docs.columns:
        for odd in slug_collisions(docs).orderBy("slug").limit(1).collect():
            raise ValueError(f"slug collision: {odd.slug} is both {odd['first']} and {odd['last']}")
    rows = docs.select("slug", F.sha2(F.col("content").cast("binary"), 256).alias("sha")).join(uploaded.select("slug", "content_sha", F.lit(1).alias("there")), "slug", "full")
    change = F.when(F.col("there").isNull(), "create").when(F.col("sha").isNull(), "map-only").when(F.col("content_sha").isNull() | (F.col("sha") != F.col("content_sha")), "update").otherwise("same")
    return rows.select("slug", change.alias("change"))


def mention_map(docs: DataFrame, base: str) -> DataFrame:
    """(url, slug): the spellings under which a document with a token is mentioned."""
    shapes = F.array(*(F.concat(F.lit(base + p), F.col("token")) for p in ("/wiki/", "/docx/", "/doc/")))
    return docs.where("token is not null").select(F.explode(shapes).alias("url"), "slug")


def reconcile_light(remote: DataFrame, minutes: int = 5) -> DataFrame:
    """Issues of documents (slug, title, uploaded_at, edited_at): another title, or edited later than the upload by a margin."""
    both = F.array_compact(F.array(F.when(F.col("title") != F.col("slug"), "title"), F.when(F.col("edited_at") > F.col("uploaded_at") + F.expr(f"interval {minutes} minutes"), "edited")))
    return remote.select("slug", F.explode(both).alias("issue"))


def reconcile_heavy(old_sha: Column, new_sha: Column) -> Column:
    return F.when(new_sha.isNull(), "error").when(old_sha.isNull(), "first-baseline").when(old_sha == new_sha, "no-drift").otherwise("drift")


def rewrite_refs(text: Column, base: str) -> tuple[Column, Column]:
    """Relative image references made public, and how many there were; again it changes nothing."""
    rule = r"(\]\(|src=\")\.?/?(images/[^)\"\s]+)"
    return F.regexp_replace(text, rule, f"$1{base}/$2"), F.regexp_count(text, F.lit(rule))


def verify_sample(ledger: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """Some rows, drawn by a hash."""
    return ledger.orderBy(F.xxhash64(F.lit(seed), "slug"), "slug").limit(n)


def prune(files: DataFrame, glob: str, keep: bool = False) -> DataFrame:
    """Disposition rows for files (slug, name) that fit a glob; keep reverts."""
    return files.where(F.col("name").rlike(T.glob_rule(glob))).select("slug", "name", F.lit("keep" if keep else "delete").alias("decision"))


def resolve_rev(revisions: DataFrame, asked: DataFrame, fallback: str = "last", key: str = "slug") -> DataFrame:
    """asked (key, spec) with rev: of `revN` that one, of a date the last fetched by the end of that day, of nothing the first or last;
    null where there is none."""
    n = F.regexp_extract("spec", r"(?i)^rev(\d+)$", 1)
    day = F.to_date(F.when(F.col("spec").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("spec")))
    rows = asked.join(revisions.select(key, "rev", "fetched_at"), key, "left")
    ok = F.when(F.col("spec").isNull(), F.lit(True)).when(n != "", F.col("rev") == n.cast("int")).when(day.isNotNull(), F.to_date("fetched_at") <= day).otherwise(False)
    wanted = F.when(ok, F.col("rev"))
    first = F.min(F.when(F.col("spec").isNull(), wanted)) if fallback == "first" else F.lit(None).cast("int")
    return rows.groupBy(key, "spec").agg(F.coalesce(first, F.max(wanted)).alias("rev"))


def history(revisions: DataFrame, key: str = "slug") -> DataFrame:
    """Revisions in the order they came, with the number of each key's and what changed since the one before."""
    w = Window.partitionBy(key).orderBy("rev")
    before = F.lag("sha").over(w)
    change = F.when(before.isNull(), "first").when(before == F.col("sha"), "same").otherwise("changed")
    return revisions.select(key, "rev", "fetched_at", "status", change.alias("change"))


SKIPPED = r"(^|/)(\.|tmp\.|_index\.json(/|$))"


def slug_files(files: DataFrame) -> DataFrame:
    """Files (slug, name: a path below the slug's folder) without dotfiles, unfinished files and indexes at any depth."""
    return files.where(~F.col("name").rlike(SKIPPED))


def slug_listing(files: DataFrame) -> DataFrame:
    """(slug, n_files, bytes, names) of files (slug, name, bytes): what stands in each slug's folder, by name."""
    return slug_files(files).groupBy("slug").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list("name")).alias("names"))


def missing_refs(pages: DataFrame, objects: DataFrame, base: str) -> DataFrame:
    """(path, key) of references in pages (path, body) to public objects, as images or in backticks, that aren't there (objects: key)."""
    quoted = T.quoted(base)
    image = F.regexp_extract_all("body", F.lit(rf"!\[(?:[^\]]|\](?!\())*\]\({quoted}/([^)]+)\)"), F.lit(1))
    caption = F.regexp_extract_all("body", F.lit(rf"`{quoted}/([^`]+)`"), F.lit(1))
    return pages.select("path", F.explode(F.concat(image, caption)).alias("key")).join(objects.select("key"), "key", "left_anti").select("path", "key")
