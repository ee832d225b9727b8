"""Catalogues, reports and tables made for people, as DataFrames of lines or cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikilake.functions import text as T

TOP_ROWS, MAX_COLUMNS = 30, 8


def sources_catalogue(sources: DataFrame) -> DataFrame:
    """(year, place, line) of sources (slug, title, year): newest year first, then slugs downwards."""
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("slug")))
    return sources.select("year", place.alias("place"), F.format_string("- [[%s]] %s", F.col("slug").cast("string"), "title").alias("line"))


def entities_catalogue(entities: DataFrame) -> DataFrame:
    """(tier, place, line) of entities (slug, tier, refs): most cited first."""
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("refs"), "slug"))
    return entities.select("tier", place.alias("place"), F.format_string("- [[%s]] (%d)", F.col("slug").cast("string"), F.col("refs").cast("long")).alias("line"))


def totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("bucket", "tier").agg(F.count("*").alias("n"))


def status_report(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(slug, part) of rows (slug, status): good, decided on, or open."""
    out = rows.join(decisions.select("slug", F.lit(True).alias("decided")).distinct(), "slug", "left")
    return out.select("slug", F.when(F.col("status") == "good", "good").when(F.col("decided"), "decided").otherwise("open").alias("part"))


def ingest_plan(candidates: DataFrame, ingested: DataFrame, queued: DataFrame, skips: DataFrame) -> DataFrame:
    """(id, outcome) of candidates (id, norm_url, quality): the first reason to leave one out, else planned."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = candidates.join(flag(ingested, "norm_url", "_i"), "norm_url", "left").join(flag(queued, "id", "_q"), "id", "left").join(flag(skips, "norm_url", "_s"), "norm_url", "left")
    outcome = F.when(F.col("_i"), "ingested").when(F.col("_q"), "queued").when(F.col("_s"), "skipped").when(F.col("quality") != "good", "quality").otherwise("planned")
    return out.select("id", outcome.alias("outcome"))


def preview(pages: DataFrame, cites: DataFrame, since: Column) -> DataFrame:
    """(new_pages, touched, tokens) of pages (slug, created, chars) made since a date and what they cite."""
    new = pages.where(F.col("created") >= since)
    n = new.agg(F.count("*").alias("new_pages"), F.coalesce(F.sum(F.round(F.col("chars") / 4)).cast("long"), F.lit(0)).alias("tokens"))
    touched = cites.join(new.select(F.col("slug").alias("src")), "src", "left_semi").agg(F.count_distinct("dst").alias("touched"))
    return n.crossJoin(touched)  # one row each


def table_lines(df: DataFrame, *order: Column | str, rows: int = TOP_ROWS, columns: int = MAX_COLUMNS) -> DataFrame:
    """(place, line): the first columns of the first rows as a pipe table's lines."""
    top = df.orderBy(*order).limit(rows)
    place = F.row_number().over(Window.orderBy(*order))  # of at most `rows` rows
    cells = [T.format_cell(F.col(c).cast("string")) for c in df.columns[:columns]]
    return top.withColumn("place", place).select("place", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def assembled(blocks: DataFrame, key: str) -> DataFrame:
    """(key, content, sha) of blocks (key, place, tag, text): white space joined, in order."""
    line = F.concat(F.lit("<"), "tag", F.lit("> "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    out = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("b"))
    content = F.array_join(F.transform("b", lambda x: x.line), "\n")
    return out.select(key, content.alias("content")).withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))


def rewrite_tags(text: Column) -> Column:
    """Markup of rich documents to Markdown: callouts, image tokens, equations, colour and layout tags."""
    rules = (
        (r"<text\b[^>]*>|</text>", ""),
        (r"<callout\b[^>]*>\s*", "> "),
        (r"\s*</callout>", ""),
        (r"<image\b[^>]*token=\"([^\"]+)\"[^>]*/?>", "![]($1)"),
        (r"<equation>([^<]*)</equation>", "\\$$1\\$"),
        (r"</?(grid|column|view|quote-container)\b[^>]*>\n?", ""),
    )
    for rule, to in rules:
        text = F.regexp_replace(text, rule, to)
    return text


def published_date(page: Column) -> Column:
    """The first of four places that give a date: meta elements, JSON-LD, a time element."""
    found = [F.regexp_extract(page, rule, 1) for rule in (r"(?i)article:published_time\"[^>]*content=\"(\d{4}-\d{2}-\d{2})", r"(?i)name=\"date\"[^>]*content=\"(\d{4}-\d{2}-\d{2})", r"\"datePublished\"\s*:\s*\"(\d{4}-\d{2}-\d{2})", r"(?i)<time[^>]*datetime=\"(\d{4}-\d{2}-\d{2})")]
    return F.coalesce(*(F.when(x != "", F.to_date(x)) for x in found))
