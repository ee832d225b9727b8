"""The prefix trie of rebuilt conversations, measured over heavy paths.

A conversation is rebuilt from the first turns of its base (the conversation whose id ends its group of 20) and its own later
turns.  A node of the trie is a distinct sequence of first turns; its name is the exclusive or of hashes of each turn with its place,
twice 64 bits, so names are running aggregates and no conversation is gathered.  Every node's heavy child is that with the most
members; a node that isn't heavy (or is the root) begins a path.  A light child has at most half of its parent's
members, so only a logarithm of the conversations of light steps lies above a node.  Measures of subtrees are suffix sums along the
paths, from the paths below most light steps up: each round sums the paths of a level and hands the sums of
their tops to the nodes above, pre-aggregated.

Runs along conversations and paths are windows within stretches of STRETCH places and over their totals, so one of any length
is spread.  The digests of the ids that end at a node need them in order: Spark sorts ids by node in ranges, tasks
join runs of them, and a node's runs are hashed in turn, without being held.

Null roles and texts are empty.  Turns are ordered by number, null first; those that tie by the MD5 of role and text, and equal rows
stay, one after the other.  Rows without a conv_id belong to no conversation and are left out.  A text or conversation of any length is whole.
An empty table has no nodes.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikilake.llm.common import attach, only, saved, small, table, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a base, and turns that may be taken from it.
GROUP, HEADS = 20, 4
#: Places of a stretch of a conversation or path.
STRETCH = 4_096
#: Ids joined in a run.
RUN = 1_024


def running(df: DataFrame, group: list[str], place: Column, values: dict[str, tuple], back: bool = False) -> DataFrame:
    """df with aggregates over the rows of the group up to each row, itself included, by place (falling places if back).
    values: by the name of the result its column, the aggregate, and how two of its results become one."""
    df = df.withColumn("stretch", F.floor(place / STRETCH).cast("long"))
    by = (lambda c: F.col(c).desc()) if back else F.col
    inside = Window.partitionBy(*group, "stretch").orderBy(place.desc() if back else place).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy(by("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "stretch").agg(*(f(c).alias(k) for k, (c, f, _) in values.items()))
    before = totals.select(*group, "stretch", F.row_number().over(Window.partitionBy(*group).orderBy(by("stretch"))).alias("nth"), *(f(F.col(k)).over(ahead).alias(f"{k}_before") for k, (_, f, _) in values.items()))
    out = df.withColumns({k: f(c).over(inside) for k, (c, f, _) in values.items()}).join(small(saved(before.where("nth > 1").drop("nth"))), [*group, "stretch"], "left")
    for k, (_, _, both) in values.items():
        out = out.withColumn(k, F.when(F.col(f"{k}_before").isNull(), F.col(k)).when(F.col(k).isNull(), F.col(f"{k}_before")).otherwise(both(F.col(k), F.col(f"{k}_before"))))
    return out.drop("stretch", *(f"{k}_before" for k in values))


ADD = (F.sum, lambda a, b: a + b)
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
LAST = (F.max, F.greatest)


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): each turn with its place in its conversation, from 0.  Turns whose numbers
    lie in one stretch are ordered together; equal rows count once and are spread again."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = only(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.groupBy("conv_id", "turn", "digest", "words").agg(F.count("*").alias("copies"))
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-(1 << 62)))
    rows = saved(rows.withColumn("part", stretch))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.sum("copies").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    at = rows.withColumn("at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(small(saved(parts.where("ahead > 0"))), ["conv_id", "part"], "left")
    at = at.withColumn("at", F.col("at") + F.coalesce("ahead", F.lit(0)))
    return at.select("conv_id", F.explode(F.expr("sequence(at, at + copies - 1)")).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, words) of every rebuilt turn, and (conv_id, length) of every conversation."""
    own = saved(placed(turns))
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("heads")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", heads, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    sizes = saved(sizes)
    there = sizes.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = sizes.join(there, "base", "left").withColumn("taken", F.least("heads", F.coalesce("n_base", F.lit(0))))
    convs = saved(convs.select("conv_id", "base", "heads", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("length")))
    # at most HEADS - 1 turns of a base, for at most 2 * GROUP conversations
    head = own.where(f"place < {HEADS - 1} and conv_id % {GROUP} = 0").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "heads"), "base").where("place < heads")
    tail = own.withColumn("heads", heads).where("place >= heads")
    tail = attach(tail, convs.where("taken < heads").select("conv_id", "taken"), "conv_id", "left").withColumn("place", F.col("place") - F.col("heads") + F.coalesce("taken", "heads"))
    both = head.select("conv_id", "place", "digest", "words").unionByName(tail.select("conv_id", "place", "digest", "words"))
    return both, convs.select("conv_id", "length")


def _named(x: Column | str, y: Column | str, name: str) -> Column:
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y")).alias(name)


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, node, parent, words) of each conversation's prefixes of one turn or more, and the conversations."""
    rows, convs = rebuilt(turns)
    rows = rows.select("conv_id", F.col("place").cast("long").alias("place"), "words", F.xxhash64("place", "digest").alias("hx"), F.xxhash64(F.lit(1), "digest", "place").alias("hy"))
    rows = running(saved(rows), ["conv_id"], F.col("place"), {"x": (F.col("hx"), *XOR), "y": (F.col("hy"), *XOR)})
    parent = _named(F.col("x").bitwiseXOR(F.col("hx")), F.col("y").bitwiseXOR(F.col("hy")), "parent")
    return saved(rows.select("conv_id", (F.col("place") + 1).alias("depth"), _named("x", "y", "node"), parent, "words")), convs


def root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def ended(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where a conversation ends."""
    last = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = last.unionByName(convs.where("length = 0").select("conv_id", root().alias("node"))).select("node.x", "node.y", "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows become runs: the ids of a node, joined."""
        node, first, ids = None, 0, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([first]), pa.array([",".join(map(str, ids))])], ["x", "y", "first", "ids"])

        for batch in batches:
            for x, y, c in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "conv_id")), strict=True):
                if node != (x, y) or len(ids) == RUN:
                    if ids:
                        yield flush()
                    node, first, ids = (x, y), c, []
                ids.append(c)
        if ids:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A node's runs, one after the other, go into one digest."""
        node, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "ids")), strict=True):
                if node != (x, y):
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (x, y), sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield _rows(out)
                out = []
        if node:
            yield _rows([(*node, digest.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(k) for k in zip(*out, strict=True)], ["x", "y", "ends_sha256"])

    in_order = saved(ends).repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    joined = in_order.mapInArrow(tidy(runs), "x long, y long, first long, ids string")
    digests = joined.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(tidy(hashed), "x long, y long, ends_sha256 string")
    return digests.select(_named("x", "y", "node"), "ends_sha256")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    rows, convs = prefixes(turns)
    top = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs")).select(root().alias("node"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), "least", "n_convs", F.lit(0).cast("long").alias("words")).where("n_convs > 0")
    nodes = rows.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    nodes = saved(nodes.unionByName(top))
    # the heavy child has the most members; of equals, the one with the smallest of them
    order = F.struct(-F.col("n_convs"), "least", "node")
    families = saved(nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.min_by("node", order).alias("heavy")))
    # the top of each node's path and the light steps above it, along a conversation that passes both
    light = ~F.col("node").eqNullSafe(F.col("heavy"))
    along = attach(rows, families.select("parent", "heavy"), "parent", "left").select("conv_id", "depth", "node", F.when(light, F.struct("depth", "node")).alias("top"), light.cast("long").alias("step"))
    along = running(saved(along), ["conv_id"], F.col("depth"), {"head": (F.col("top"), *LAST), "level": (F.col("step"), *ADD)})
    paths = along.groupBy("node").agg(F.first("head").alias("head"), F.first("level").alias("level"))
    paths = nodes.join(paths, "node", "left").join(families.withColumnRenamed("parent", "node"), "node", "left")
    nodes = saved(paths.select("node", "parent", "depth", "least", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), F.col("n_children").isNull().cast("long").alias("own_leaf"), F.coalesce("head.node", root()).alias("path"), F.coalesce("level", F.lit(0)).alias("level")))
    levels = nodes.agg(F.max("level")).first()[0] or 0
    done, handed = [], None
    for level in range(levels, -1, -1):
        here = nodes.where(F.col("level") == level)
        leaves, spared = F.col("own_leaf"), F.col("own_saved")
        if handed is not None:
            here = here.join(handed, "node", "left")
            leaves, spared = leaves + F.coalesce("more_leaves", F.lit(0)), spared + F.coalesce("more_saved", F.lit(0))
        sums = running(here, ["path"], F.col("depth"), {"n_leaves": (leaves, *ADD), "saved_tokens": (spared, *ADD)}, back=True)
        sums = saved(sums.select("node", "parent", "depth", "least", "n_convs", "n_children", "n_leaves", "saved_tokens", (F.col("node") == F.col("path")).alias("first")))
        done.append(sums)
        handed = saved(sums.where("first").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))) if level else None
    every = saved(reduce(DataFrame.unionByName, done).join(ended(rows, convs), "node", "left"))
    named = attach(every, nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id")), "parent", "left")
    none = F.lit(sha256(b"").hexdigest())
    return named.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the
    trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


#: Each node's measures from all pairs of it and a prefix of it.  CRC-32 is computed by its bits.
SQL = f"""
WITH digests AS (SELECT conv_id, turn, concat(md5(coalesce(role, '')), md5(coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM digests),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % {HEADS} AS heads
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
sized AS MATERIALIZED (SELECT c.*, least(c.heads, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (SELECT s.conv_id, o.place AS place, digest, words FROM sized s JOIN own o ON o.conv_id = s.base AND o.place < s.heads
  UNION ALL SELECT s.conv_id, o.place - s.heads + s.taken, digest, words FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.place >= s.heads),
named AS MATERIALIZED (SELECT conv_id, place + 1 AS depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place)) AS node FROM rebuilt),
up AS MATERIALIZED (SELECT *, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM named),
every AS (SELECT node, parent, depth, words, conv_id, ends FROM up UNION ALL SELECT '', NULL, 0, 0, conv_id, conv_id NOT IN (SELECT conv_id FROM up) FROM convs),
nodes AS MATERIALIZED (SELECT node, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids FROM every GROUP BY node),
children AS MATERIALIZED (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT '' AS node, node AS below FROM nodes UNION ALL SELECT DISTINCT a.node, b.node FROM named a JOIN named b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT a.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved FROM above a JOIN nodes b ON b.node = a.below LEFT JOIN children c ON c.node = a.below GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node
"""
