"""Threads of nested posts in JSON, walked level by level as VARIANT, and their Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.sources.writers import scratch

#: Titles of a post that its author or a moderator has taken away.
DELETED = r"(?i)^\[(?:deleted by user|removed|deleted)\]$"


def walked(threads: DataFrame, replies: str = "replies") -> DataFrame:
    """(key, path, depth, author, score, body) of every post of threads (key, json): an object or an array of objects, each with its answers under
    `replies`.  path holds the places of a post and of those above it, so it orders a thread.

    There is a step for each level, with as many rows as the level has posts; levels are written to the shared folder, so a deep thread
    doesn't make a deep plan.  What isn't JSON has no posts; missing fields are null."""
    field = lambda c, name, kind="string": F.try_variant_get(c, f"$.{name}", kind)
    spark, folder = threads.sparkSession, scratch(threads.sparkSession, "threads")
    roots = threads.select("key", F.try_parse_json("json").alias("v")).where("v is not null")
    single = F.schema_of_variant("v").startswith("OBJECT")
    here = roots.where(single).select("key", F.array(F.lit(0)).alias("path"), "v").unionByName(_children(roots.where(~single).withColumn("path", F.array().cast("array<int>")), F.col("v")))
    levels = []
    while True:
        where = f"{folder}/{len(levels)}"
        here.write.parquet(where)
        here = spark.read.parquet(where)
        if not here.limit(1).count():
            break
        levels.append(here.select("key", "path", F.lit(len(levels)).alias("depth"), field(F.col("v"), "author").alias("author"), field(F.col("v"), "score").alias("score"), field(F.col("v"), "body").alias("body")))
        here = _children(here, F.try_variant_get("v", f"$.{replies}", "variant"))
    return reduce(DataFrame.unionByName, levels) if levels else here.select("key", "path", F.lit(0).alias("depth"), *(F.lit(None).cast("string").alias(c) for c in ("author", "score", "body")))


def _children(rows: DataFrame, nested) -> DataFrame:
    """(key, path, v) of the members of a variant array of rows (key, path); none where there is no array."""
    listed = rows.select("key", "path", nested.alias("w")).where("w is not null and schema_of_variant(w) like 'ARRAY%'")
    members = listed.select("key", "path", F.posexplode(F.try_variant_get("w", "$", "array<variant>")).alias("at", "v"))
    return members.where("schema_of_variant(v) like 'OBJECT%'").select("key", F.array_append("path", F.col("at")).alias("path"), "v")


def rendered(posts: DataFrame) -> DataFrame:
    """(key, posts, markdown) of walked posts: a heading for each of the first level, answers as quotes as deep as they stand."""
    name, score = F.coalesce("author", F.lit("[deleted]")), F.coalesce("score", F.lit("?"))
    body = F.coalesce("body", F.lit(""))
    quoted = F.concat(F.lit("**u/"), name, F.lit("** · score "), score, F.lit("\n\n"), body)
    mark = F.repeat(F.lit("> "), F.col("depth"))
    lines = F.transform(F.split(quoted, "\n"), lambda x: F.when(x == "", F.rtrim(mark)).otherwise(F.concat(mark, x)))
    block = F.when(F.col("depth") == 0, F.concat(F.lit("## u/"), name, F.lit("\n\n> score "), score, F.lit("\n\n"), body)).otherwise(F.array_join(lines, "\n"))
    gathered = posts.groupBy("key").agg(F.count("*").alias("posts"), F.array_sort(F.collect_list(F.struct("path", block.alias("block")))).alias("blocks"))
    return gathered.select("key", "posts", F.array_join(F.transform("blocks", lambda x: x.block), "\n\n").alias("markdown"))
