"""Queries over a paged source, the queue's state machine, repeated log rows and nested threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.operators import threads
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry
from wikilake.sources.paged import PAGE_SIZE, Paged
from wikilake.sources.writers import scratch
from wikilake.streaming import queue, windows

QUERIES, SQL, query = registry()
_KINDS = ("add", "start", "done", "add", "errored", "reset", "start")


def _commands(events):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("command"))


_ANSWERED = f"""WITH c AS (SELECT user_id AS id, event_id AS seq, [{", ".join(f"'{k}'" for k in _KINDS)}][event_id % {len(_KINDS)} + 1] AS command FROM events),
  t AS (SELECT *, row_number() OVER w AS n, coalesce(bool_or(command = 'add') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM c WINDOW w AS (PARTITION BY id ORDER BY seq)),
  m AS (SELECT *, max(CASE WHEN command <> 'start' AND there <> (command = 'add') THEN n END) OVER e AS last, max(CASE WHEN command = 'start' AND there THEN n END) OVER e AS started FROM t WINDOW e AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT m.id, m.seq, m.command, CASE WHEN m.last IS NULL THEN NULL WHEN l.command = 'done' THEN 'done' WHEN m.started > m.last THEN 'in-progress' WHEN l.command = 'errored' THEN 'errored' ELSE 'pending' END AS before FROM m LEFT JOIN t l ON l.id = m.id AND l.n = m.last),
  r AS (SELECT *, CASE WHEN command = 'add' THEN CASE WHEN before IS NOT NULL THEN 'entry exists' END WHEN before IS NULL THEN 'no entry' WHEN command = 'start' AND before = 'done' THEN 'already done' END AS reason FROM b)
  SELECT id, seq, command, before, reason IS NULL AS accepted, CASE WHEN reason IS NOT NULL THEN before WHEN command IN ('add', 'reset') THEN 'pending' WHEN command = 'start' THEN 'in-progress' ELSE command END AS after, reason FROM r"""


@query(_ANSWERED)
def queue_answered(spark, d):
    return queue.answered(_commands(A.table(spark, d, "events")))


@query(_ANSWERED)
def queue_replayed(spark, d):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, queue.PROVIDER)  # a query takes it when it starts
    try:
        return windows.run_once(queue.replayed(_commands(windows.read_events(spark, d))), "append")
    finally:
        spark.conf.set(key, was)


@query("SELECT user_id AS slug, event_type AS outcome, count(*) AS n, max(ts) AS last FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def log_deduplicated(spark, d):
    """Every log row comes twice; a stream counts it once."""
    events = spark.readStream.schema(windows.SCHEMA).parquet(f"{d}/event[s].parquet")
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = windows.run_once(windows.logged_once(twice.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("slug"), F.col("event_type").alias("outcome"))), "append")
    return rows.groupBy("slug", "outcome").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last"))


@query("SELECT page_id AS bookmark_id, concat('page ', page_id) AS title, url AS link, page_id % 5 AS collection_id, concat('t', page_id % 3) AS tag FROM pages")
def bookmarks_paged(spark, d):
    """The pages as an API's answers, a file a page, read again by the paged source."""
    p = A.table(spark, d, "pages")
    item = F.struct(F.col("page_id").alias("_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("link"), F.struct((F.col("page_id") % 5).alias("$id")).alias("collection"), F.array(F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string"))).alias("tags"))
    answers = p.groupBy(F.expr(f"page_id div {PAGE_SIZE}").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    total = p.agg(F.count("*").alias("count"))
    folder = scratch(spark, "answers")
    answers.join(F.broadcast(total)).select("page", F.to_json(F.struct("items", "count")).alias("value")).write.partitionBy("page").text(folder)  # one row
    spark.dataSource.register(Paged)
    rows = spark.read.format("paged").option("url", folder.removeprefix("file:") + "/page={page}").load()
    return rows.select("bookmark_id", "title", "link", "collection_id", F.col("tags")[0].alias("tag"))


@query(
    """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
    SELECT conv_id AS key, count(*) AS posts, sha256(string_agg(CASE WHEN k = 0 THEN concat('## u/', role, chr(10), chr(10), '> score ', length(text), chr(10), chr(10), text) ELSE array_to_string(list_transform(string_split(concat('**u/', role, '** · score ', length(text), chr(10), chr(10), text), chr(10)), lambda x: CASE WHEN x = '' THEN rtrim(repeat('> ', k)) ELSE concat(repeat('> ', k), x) END), chr(10)) END, concat(chr(10), chr(10)) ORDER BY k)) AS sha FROM t GROUP BY conv_id"""
)
def threads_nested(spark, d):
    """Each conversation as JSON in which a turn answers the one before, walked and rendered."""
    turn = F.struct("turn", F.struct(F.col("role").alias("author"), F.length("text").alias("score"), F.col("text").alias("body")).alias("post"))
    turns = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(turn))).alias("turns"))
    head = lambda x: F.regexp_replace(F.to_json(x.post), r"\}$", "")
    nested = F.aggregate("turns", F.lit(""), lambda inner, x: F.concat(head(x), F.lit(',"replies":['), inner, F.lit("]}")))
    posts = threads.walked(turns.select(F.col("conv_id").alias("key"), nested.alias("json")))
    rows = threads.rendered(posts)
    return rows.select("key", "posts", F.sha2(F.col("markdown").cast("binary"), 256).alias("sha"))
