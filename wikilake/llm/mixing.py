"""Mixing sources to target weights, in DataFrame operations alone.

The words of a source form one stream, its documents in the order of a hash; the stream is packed into blocks of a fixed
length, of which the last may be short.  The output is a row of slots, a block each, cut into shards.  Every slot draws
its source, so a shard's counts are multinomial with the targets as weights; what the draws leave above a source's share of
all slots, at the end of its row, goes to the sources that got too few.  The k-th slot of a source takes the block at place k
of the source's epochs: each epoch is a pseudorandom permutation of the full blocks, with the short one last.  So the words
that precede a slot follow from k alone, the last slot of a source takes just what its target still lacks, and no block
comes more often than the target holds the source.  Blocks and documents meet by the block's number.

Weights repeat over the sources by code point, a null source last.  A target stops at `most` times its source's size; the excess
is shared again by weight.  Null and empty texts have no words and are never taken; they are told with 0.
Rows that share a doc_id, or have none, are documents of their own; equal rows are taken each for itself, one after the other in the
stream, so reruns agree.  A text of any length is one document.  An empty table gives no rows.  Other columns,
of whatever names, are not looked at.  The table of sources has a row a source and is the only one ordered in one task.
"""

from __future__ import annotations

from math import lcm
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikilake.llm.common import attach, only, saved, small, table

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard.
BLOCK, SHARD = 512, 1024
#: Weights by turns, the mix in percent of all words, and how often a source is taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 150, 2
#: Documents of a stretch of a stream, about, and shards of a stretch of shards: sums run within them, then over them.
STRETCH = 1_024
ROUNDS, SEED = 4, 11


class Mix(NamedTuple):
    """documents: key, hash, doc_id, size, copies; sources: key, s, weight, source_size, target, words; streams: s, key, hash, doc_id, size, begin (its first word's
    place); slots: shard, slot, s, epoch, block, length (words taken from the block's begin)."""

    documents: DataFrame
    sources: DataFrame
    streams: DataFrame
    slots: DataFrame
    block: int


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x (0 <= x < n) under the key's permutation of n places: a Feistel network on pairs of residues, whose
    product holds n, walked on from the places that exceed n, of which there are fewer than the square root of n."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def once(y: Column) -> Column:
        def turn(pair: Column, k: Column) -> Column:
            left = (pair.l + F.pmod(F.xxhash64(F.lit(SEED), *key, k, pair.r), a)) % a
            right = (pair.r + F.pmod(F.xxhash64(F.lit(SEED), *key, k, pair.l), b)) % b
            odd = k % 2 == 1
            return F.struct(F.when(odd, left).otherwise(pair.l).alias("l"), F.when(odd, pair.r).otherwise(right).alias("r"))

        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(F.floor(y / b).cast("long").alias("l"), (y % b).alias("r")), turn, lambda pair: pair.l * b + pair.r)

    # the walk is evaluated only where the first step leads beyond n
    return F.aggregate(F.array(once(x)), F.lit(0).cast("long"), lambda _, y: F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), y, lambda z, _: F.when(z < n, z).otherwise(once(z)))))


def running(df: DataFrame, group: str, stretch: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of the group that precede, in stretches that follow the order: within
    each by a window, over their sums by another.  Only the sums of a group meet in one task."""
    df = df.withColumn("stretch", stretch)
    sums = df.groupBy(group, "stretch").agg(F.sum(value).alias("sum"))
    w = Window.partitionBy(group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(group, "stretch", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("ahead"))
    w = Window.partitionBy(group, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(ahead, [group, "stretch"]).withColumn(name, F.col(name) + F.col("ahead")).drop("stretch", "ahead")


def sized(docs: DataFrame) -> DataFrame:
    """(key, hash, doc_id, size, copies): documents with their words; key names the source, a null one last."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))
    rows = only(docs, "doc_id", "text", "source").select(key.alias("key"), F.xxhash64("doc_id", "text").alias("hash"), "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("key", "hash", "doc_id", "size").agg(F.count("*").alias("copies"))


def targets(rows: DataFrame, block: int, weights: tuple[int, ...], share: int, most: int) -> DataFrame:
    """A row for each source of sized(): its number s, target, words (the target in whole words), full and blocks of its
    stream, slots (what takes so many words), and start, the first of its slots in a row of all."""
    w = Window.orderBy("key")
    turns = F.array(*map(F.lit, weights))
    one = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).withColumn("s", (F.row_number().over(w) - 1).cast("long"))
    one = one.withColumn("weight", F.element_at(turns, (F.col("s") % len(weights) + 1).cast("int")).cast("long"))
    # filled by rising share of the weight: those before are at their limit if this one is
    exact = lambda c: c.cast("decimal(38,0)")
    size, weight = exact(F.col("source_size")), exact(F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("source_size") * (F.lit(lcm(*weights)) / F.col("weight")).cast("long"), "s").rowsBetween(Window.unboundedPreceding, -1)
    total = exact(F.sum(size).over(every))
    one = one.select("*", exact(total * share).alias("all"), exact(F.coalesce(F.sum(size).over(before), F.lit(0))).alias("ahead"), exact(F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0))).alias("left"))
    limit = 100 * most
    one = one.withColumn("full_up", F.col("weight") * (F.col("all") - F.col("ahead") * limit) >= F.col("left") * limit * F.col("source_size"))
    gone = F.coalesce(F.sum(F.when(F.col("full_up"), size)).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("full_up"), weight)).over(every)
    one = one.withColumn("target", F.when(F.col("full_up"), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * (F.col("all") - gone * limit)).cast("double") / (open_ * 100).cast("double")))
    one = one.withColumn("words", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * most))
    one = one.withColumn("full", F.expr(f"source_size div {block}L")).withColumn("blocks", F.expr(f"(source_size + {block - 1}L) div {block}L"))
    one = one.withColumn("slots", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr(f"words div source_size * blocks + (words % source_size + {block - 1}L) div {block}L")).cast("long"))
    one = one.withColumn("start", F.coalesce(F.sum("slots").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return one.drop("all", "ahead", "left", "full_up")


def drawn(spark: SparkSession, sources: DataFrame, shard: int) -> DataFrame:
    """(shard, slot, s, k): every slot with its source and its place k in the source's row of slots, from 0 without a gap."""
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    total = max(1, n.n)
    width = max(1, total // (4 * max(1, n.sources)))  # of the cells by which draws and sources meet
    # a slot's draw is a number below the count of all slots; the source that has this number in the row of all gets it
    draws = spark.range(n.n).select(F.expr(f"id div {shard}L").alias("shard"), F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(total)).alias("u"))
    cells = sources.where("slots > 0").select("s", "start", (F.col("start") + F.col("slots")).alias("end"), F.explode(F.expr(f"sequence(start div {width}L, (start + slots - 1) div {width}L)")).alias("cell"))
    draws = draws.withColumn("cell", F.expr(f"u div {width}L")).join(small(saved(cells)), "cell").where("u >= start and u < end")
    rank = F.row_number().over(Window.partitionBy("shard", "s").orderBy("slot"))
    draws = saved(draws.select("shard", "slot", "s", (rank - 1).cast("long").alias("rank")))
    counts = running(draws.groupBy("s", "shard").agg(F.count("*").alias("n")), "s", F.expr(f"shard div {STRETCH}L"), ["shard"], F.col("n"), "ahead_of_shard")
    draws = draws.join(counts.select("s", "shard", "ahead_of_shard"), ["shard", "s"]).select("shard", "slot", "s", (F.col("rank") + F.col("ahead_of_shard")).alias("k"))
    # slots beyond a source's share go to the sources that lack some, in the order of a permutation
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    got = sources.select("s", "slots").join(draws.groupBy("s").agg(F.count("*").alias("got")), "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("extra", F.greatest(F.col("got") - F.col("slots"), F.lit(0))).withColumn("lack", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    got = saved(got.withColumn("extra_at", F.coalesce(F.sum("extra").over(w), F.lit(0))).withColumn("lack_at", F.coalesce(F.sum("lack").over(w), F.lit(0))))
    moved = got.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n")).first().n
    draws = attach(saved(draws), got.select("s", "slots", "extra_at"), "s")
    kept = draws.where("k < slots").select("shard", "slot", "s", "k")
    extra = draws.where("k >= slots").select("shard", "slot", permuted(F.col("extra_at") + F.col("k") - F.col("slots"), F.lit(max(1, moved))).alias("at"))
    lack = got.where("lack > 0").select("s", "got", "lack_at", F.explode(F.expr("sequence(0L, lack - 1)")).alias("i"))
    return kept.unionByName(extra.join(lack.select("s", (F.col("got") + F.col("i")).alias("k"), (F.col("lack_at") + F.col("i")).alias("at")), "at").drop("at"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> Mix:
    """The mix of docs (doc_id, text, source): which words of which document stand in which slot."""
    rows = saved(sized(docs))
    sources = saved(targets(rows, block, weights, share, most))
    bits = max(1, (rows.count() // STRETCH).bit_length())
    streams = attach(rows.where("size > 0"), sources.select("key", "s"), "key")
    streams = running(streams, "s", F.shiftright("hash", 64 - bits), ["hash", "doc_id", "size"], F.col("size") * F.col("copies"), "before")
    streams = streams.select("s", "key", "hash", "doc_id", "size", "before", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    streams = streams.select("s", "key", "hash", "doc_id", "size", (F.col("before") + F.col("copy") * F.col("size")).alias("begin"))
    slots = attach(saved(drawn(docs.sparkSession, sources, shard)), sources.select("s", "source_size", "words", "full", "blocks"), "s")
    slots = slots.withColumn("epoch", F.expr("k div blocks")).withColumn("place", F.expr("k % blocks"))
    short = F.col("place") == F.col("full")
    slots = slots.withColumn("block", F.when(short, F.col("full")).otherwise(permuted(F.col("place"), F.greatest(F.col("full"), F.lit(1)), F.col("s"), F.col("epoch"))))
    holds = F.when(short, F.col("source_size") - F.col("full") * block).otherwise(F.lit(block))
    slots = slots.withColumn("length", F.least(holds, F.col("words") - F.col("epoch") * F.col("source_size") - F.col("place") * block))
    return Mix(rows, sources, streams, slots.select("shard", "slot", "s", "epoch", "block", "length"), block)


def pieces(streams: DataFrame, block: int) -> DataFrame:
    """streams with a row for each block in which a document has words: block, and the places in it from lo on, below hi."""
    spread = streams.select("*", F.explode(F.expr(f"sequence(begin div {block}L, (begin + size - 1) div {block}L)")).alias("block"))
    at = F.col("block") * block
    return spread.select("*", (F.greatest("begin", at) - at).alias("lo"), (F.least(F.col("begin") + F.col("size"), at + block) - at).alias("hi"))


def placed(mixed: Mix) -> DataFrame:
    """(shard, slot, s, key, hash, doc_id, lo, first, n): what stands in each slot: n words of a document from its word
    number `first` on, and where they begin in the block."""
    found = pieces(mixed.streams, mixed.block).join(mixed.slots, ["s", "block"]).where("lo < length")
    return found.select("shard", "slot", "s", "key", "hash", "doc_id", "lo", (F.col("lo") + F.col("block") * mixed.block - F.col("begin")).alias("first"), (F.least("hi", "length") - F.col("lo")).alias("n"))


def texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """(shard, slot, source, text): the mix itself, a block's words joined by a space.  Texts are shuffled once, in pieces
    of at most a block; a slot gathers at most a block's words."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))
    whole = only(docs, "doc_id", "text", "source").select(key.alias("key"), F.xxhash64("doc_id", "text").alias("hash"), "source", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("tokens"))
    parts = whole.dropDuplicates(["key", "hash"]).join(pieces(mixed.streams, mixed.block), ["key", "hash"])
    first = F.col("lo") + F.col("block") * mixed.block - F.col("begin")
    parts = parts.select("s", "block", "source", "lo", F.slice("tokens", (first + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("tokens"))
    parts = parts.join(mixed.slots, ["s", "block"]).where("lo < length").withColumn("tokens", F.slice("tokens", F.lit(1), (F.col("length") - F.col("lo")).cast("int")))
    gathered = parts.groupBy("shard", "slot", "source").agg(F.sort_array(F.collect_list(F.struct("lo", "tokens"))).alias("parts"))
    return gathered.select("shard", "slot", "source", F.array_join(F.flatten("parts.tokens"), " ").alias("text"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs; options as for mix()."""
    mixed = mix(docs, **options)
    parts = pieces(mixed.streams, mixed.block).join(mixed.slots.select("s", "block", "length"), ["s", "block"], "left")
    had = F.greatest(F.least("hi", F.coalesce("length", F.lit(0))) - F.col("lo"), F.lit(0))
    sums = parts.groupBy("s", "begin", "doc_id", "size").agg(F.sum(had).alias("taken")).select("s", "doc_id", "size", "taken")
    bare = attach(mixed.documents.where("size = 0").select("key", "doc_id", "size", F.explode(F.expr("sequence(1L, copies)")).alias("copy")), mixed.sources.select("key", "s"), "key")
    every = sums.unionByName(bare.select("s", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return attach(saved(every), mixed.sources.select("s", "source_size", "target"), "s").select("doc_id", "size", "source_size", "target", "taken")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    return taken(table(spark, sf_dir, "documents"))
