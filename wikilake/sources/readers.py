"""Readers: pages, records, logs, registries, tables inside pages, and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikilake.functions import text as T

BUCKETS = ("00_Meta", "01_Topics", "02_Entities", "03_Sources")
REVISION = "slug string, rev int, fetched_at string, content_file string, content_sha string, content_length long, quality_status string, quality_flags array<string>, failure_kind string, image_count int, fetcher string, fetcher_reason string, body_pruned boolean"
BOOKMARKS = "fetched_at string, total long, bookmarks array<struct<bookmark_id:long,title:string,link:string,created:string,collection_id:long,tags:array<string>>>"
SOURCE = "fetched_at string, origin string, origin_url string, fetcher string, fetcher_reason string, content_sha string, content_length long, quality_flags array<string>, quality_status string, images array<struct<local:string,remote:string,bytes:long>>, notes array<string>, upstream struct<etag:string,last_modified:string,last_checked_at:string>, error_detail string"
LEDGER = "slug string, host string, uploaded_at string, files array<struct<name:string,sha:string,bytes:long>>, r2_deletes array<struct<name:string,reason:string>>"
DISPOSITION = "slug string, host string, file string, action string, reason string, decided_at string"
INDEX = "map<string,struct<slug:string,repo_path:string,source_url:string,ingested_at:string>>"
MAX_PAGES, PAGE_SIZE = 60, 50  # of a paged interface


def wiki_pages(spark: SparkSession, root: str) -> DataFrame:
    """(repo_path, slug, bucket, frontmatter, body, links) of the .md files of the four buckets; names that begin with a dot are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.md").text([f"{root}/{b}" for b in BUCKETS], wholetext=True)
    path = F.regexp_extract(F.url_decode("_metadata.file_path"), "(" + "|".join(BUCKETS) + r")(/.*)$", 0)
    rows = files.select(path.alias("repo_path"), "value").where(~F.col("repo_path").rlike(r"/\."))
    return rows.select("repo_path", F.regexp_extract("repo_path", r"([^/]+)\.md$", 1).alias("slug"), F.split("repo_path", "/")[0].alias("bucket"), T.frontmatter_map(F.col("value")).alias("frontmatter"), T.body(F.col("value")).alias("body"), T.wikilinks(T.body(F.col("value"))).alias("links"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of append-only logs with file, line (its place by offset order within a file) and corrupt."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # A file is read in order, so the running id orders its lines; the number is counted within the file.
    line = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    parsed = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = rows.where(F.trim("value") != "").withColumn("line", line).withColumn("r", parsed)
    return rows.select("file", "line", F.col("r._corrupt").isNotNull().alias("corrupt"), "r.*").drop("_corrupt")


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOKMARKS).json(path, multiLine=True).select(F.explode("bookmarks").alias("b")).select("b.*")


def raw_records(spark: SparkSession, root: str) -> DataFrame:
    """host, slug and the record of every <root>/<host>/<slug>/source.json."""
    rows = spark.read.schema(SOURCE).option("multiLine", True).json(f"{root}/*/*/source.json")
    parts = F.split("_metadata.file_path", "/")
    return rows.select(F.element_at(parts, -3).alias("host"), F.element_at(parts, -2).alias("slug"), "*")


def sources_index(spark: SparkSession, path: str) -> DataFrame:
    """(norm_url, slug, repo_path, source_url, ingested_at); a corrupt file is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", INDEX, {"mode": "FAILFAST"}).alias("m"))
    return rows.select(F.explode("m").alias("norm_url", "r")).select("norm_url", "r.*")


def _bullets(spark: SparkSession, path: str) -> DataFrame:
    """Bullets of a registry, without those in HTML comments."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("t"))
    return text.select(F.explode(F.filter(T.lines(F.col("t")), lambda x: x.startswith("- "))).alias("line"))


def fetch_decisions(spark: SparkSession, path: str) -> DataFrame:
    """`- slug — reason`"""
    return _bullets(spark, path).select(F.regexp_extract("line", r"^- (\S+) — (.*)$", 1).alias("slug"), F.regexp_extract("line", r"^- (\S+) — (.*)$", 2).alias("reason")).where("slug <> ''")


def kind_overrides(spark: SparkSession, path: str) -> DataFrame:
    """`- slug: pin-kind=kind # note`"""
    rule = r"^- ([^\s:]+): pin-kind=([a-z-]+)"
    return _bullets(spark, path).select(F.regexp_extract("line", rule, 1).alias("slug"), F.regexp_extract("line", rule, 2).alias("kind")).where("slug <> ''")


def ingest_skips(spark: SparkSession, path: str) -> DataFrame:
    """`- key — skip-reason=code · text`"""
    rule = r"^- (\S+) — skip-reason=([\w-]+)(?: · (.*))?$"
    return _bullets(spark, path).select(*(F.regexp_extract("line", rule, k).alias(n) for k, n in ((1, "key"), (2, "code"), (3, "text")))).where("key <> ''")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """`- variant → canonical`"""
    rule = r"^- (.+?) → (.+)$"
    return _bullets(spark, path).select(F.trim(F.regexp_extract("line", rule, 1)).alias("variant"), F.trim(F.regexp_extract("line", rule, 2)).alias("canonical")).where("variant <> ''")


def csv_text(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of CSV text in a column, one line each, with quotes and doubled quotes; empty lines are dropped."""
    rows = df.withColumn("_line", F.explode(F.filter(T.lines(F.col(column)), lambda x: F.regexp_replace(x, '[,"\\s]', "") != "")))
    return rows.withColumn("_r", F.from_csv("_line", schema, {"quote": '"', "escape": '"'})).select(*df.columns, "_r.*")


def image_kind(content: Column) -> Column:
    """png, jpg, gif, webp, svg, bmp or tiff by the first bytes; null for what is no image."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(F.substring(content, 1, 256).cast("string").rlike("<svg"), "svg")
    )


def images(spark: SparkSession, root: str, least: int = 512) -> DataFrame:
    """(path, bytes, kind, is_image) of the files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.col("length").alias("bytes"), image_kind(F.col("content")).alias("kind")).withColumn("is_image", F.col("kind").isNotNull() & (F.col("bytes") >= least))


def residue(files: DataFrame) -> DataFrame:
    """(dir, problem) of a listing (dir, name): phantom folders without a record, folders with only images, unfinished files."""
    has = lambda rule: F.bool_or(F.col("name").rlike(rule))
    all_ = lambda rule: F.bool_and(F.col("name").rlike(rule))
    rows = files.groupBy("dir").agg(has(r"\.tmp$").alias("tmp"), all_(r"\.(png|jpe?g|gif|webp|svg)$").alias("only"), has(r"^source\.json$").alias("record"))
    problem = F.when(F.col("tmp"), "unfinished").when(F.col("only"), "images-only").when(~F.col("record"), "phantom")
    return rows.select("dir", problem.alias("problem")).where("problem is not null")


def stored_status(records: DataFrame, contents: DataFrame) -> DataFrame:
    """Records (slug, quality_status) with what their content (slug, live) says: failed without content, else stored, else live."""
    both = records.join(contents, "slug", "full")
    return both.withColumn("status", F.when(F.col("live").isNull(), "failed").otherwise(F.coalesce("quality_status", "live")))
