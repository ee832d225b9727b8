"""Event windows, in batch and as streams, and a keyed fold with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from wikilake.sources.writers import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """A stream of the event files in a folder; a watermark needs a timestamp with a zone."""
    rows = spark.readStream.schema(SCHEMA).parquet(f"{folder}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, length: str) -> DataFrame:
    rows = events.groupBy("event_type", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    rows = events.groupBy("event_type", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user; the id breaks ties."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, purchases = state.get if state.exists else (0, 0)
    for b in batches:
        n += len(b)
        purchases += int((b.event_type == "purchase").sum())
    state.update((n, purchases))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "purchases": [purchases]})


def fold(events: DataFrame) -> DataFrame:
    """Counts of each user's events as they come, with state between batches."""
    kind = "user_id long, n long, purchases long"
    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(_fold, kind, "n long, purchases long", "update", GroupStateTimeout.NoTimeout)


def logged_once(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of log rows (ts, slug, outcome, ..) of which repeated ones count once: rows are the same if ts, slug and outcome are.  A
    row that comes after the stream has seen another one `delay` later is late and left out; lateness() tells which."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ts", "slug", "outcome"])


def lateness(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """log (batch, ts, ..) with late: whether the batches before a row's had shown a time `delay` or more after it."""
    times = log.groupBy("batch").agg(F.max("ts").alias("seen"))
    shown = times.select("batch", F.max("seen").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)).alias("shown"))
    return log.join(F.broadcast(shown), "batch").withColumn("late", F.coalesce(F.col("ts") <= F.col("shown") - F.expr(f"interval {delay}"), F.lit(False))).drop("shown")  # a row a batch


def run_once(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now.  The executors write each batch to a folder that all machines share; of complete
    results the last batch counts, of others all.  With a key, the last row of each."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number:09d}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row
    if key is None:
        return rows.drop("batch")
    return rows.groupBy(key).agg(*(F.max_by(c, "batch").alias(c) for c in stream.columns if c != key))
