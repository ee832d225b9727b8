"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the token positions of a window; the hashes of the picked tokens
of test items and of training texts are joined, so a hit survives substitutions at the
positions that a mask ignores.  Around each hit the text and the item are laid beside
each other and the best stretch is measured: one point for an equal token, minus
MISMATCH for another.  A stretch with enough equal tokens is an overlap.

Items of fewer than SHORT tokens have masks of their own, one for each way to ignore as many of
their tokens as an overlap may lack, so none is missed; their stretch is from the first equal token
to the last.

Equal items, and equal texts, are compared once.  Nulls and empty texts on either side have no overlap.  A
text of any length is searched whole; what is sent on of it for a hit is as long as the item.  Items
with equal texts and rows that repeat a doc_id are each reported, once for each pair of ids, with
the longest overlap; of ties the first in the text.  Rows with a null key are reported under it.
Either table may be empty: then there is no overlap.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import bitset, has, only, saved, small, table, tidy

#: Positions of a window that count; a window spans ten tokens.
MASKS = ((0, 1, 2, 5, 7, 9), (0, 2, 3, 4, 8, 9), (0, 1, 4, 6, 8, 9), (0, 1, 3, 5, 6, 9))
#: Below this length an overlap needs MIN_ITEM_SHARE of the item, and all masks that allow it are few.
SHORT = 13
MISMATCH = 1.5
#: An overlap has this many equal tokens, or this share of a shorter item, and this share of equal tokens in its stretch.
MIN_EQUAL, MIN_ITEM_SHARE, MIN_IDENTITY = 10, 0.8, 0.75
FILTER_BITS = 25


@lru_cache(maxsize=64)
def short_masks(lengths: tuple[int, ...]) -> list[tuple[int, ...]]:
    """All choices of the tokens that an overlap with an item of one of the lengths has at least; each begins at 0."""
    need = {n: next(k for k in range(n + 1) if enough(k, k, n)) for n in lengths}
    return sorted({tuple(p - m[0] for p in m) for n, k in need.items() for m in combinations(range(n), k)})


def seeds(h: np.ndarray, d: np.ndarray, counts: np.ndarray, short: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first tokens) of all windows of each mask, and of each of the masks of short items."""
    for k, mask in enumerate((*MASKS, *short)):
        out, at = K.windows(h, d, counts, mask)
        yield K.mix(out ^ K.U64((k if k < len(MASKS) else 100 + sum(1 << p for p in mask)) + 1)), at


_SEEDS = pa.struct([("seed", pa.int64()), ("at", pa.int32())])


def _listed(seed: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list of (seed, at) for each of n owners."""
    order = np.argsort(owner, kind="stable")
    pairs = pa.StructArray.from_arrays([pa.array(seed[order].view(np.int64)), pa.array(at[order].astype(np.int32))], fields=list(_SEEDS))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)), pairs)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and seeds of test items."""
    for batch in batches:
        for i, j, part, off in K.blocks(*K.column(batch, "text")):
            h, d = K.words(part, off)
            counts = np.bincount(d, minlength=j - i)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            found = [(np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k in range(j - i):
                n = int(counts[k])
                for s, at in seeds(h[cuts[k] : cuts[k + 1]], np.zeros(n, np.int64), counts, short_masks((n,)) if 0 < n < SHORT else []):
                    found.append((s, at, np.full(len(s), k)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), K.lists(h.view(np.int64), cuts), _listed(*map(np.concatenate, zip(*found, strict=True)), j - i)], ["item_id", "item", "seeds"])


def measured(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal tokens, first and last + 1 token of the text) of the best stretch with the item's token k beside
    the text's token k + shift."""
    a, b = max(0, -shift), min(len(item), len(text) - shift)
    if a >= b:
        return 0, 0, 0
    same = item[a:b] == text[a + shift : b + shift]
    if len(item) < SHORT:
        hit = np.flatnonzero(same)
        return (len(hit), a + shift + int(hit[0]), a + shift + int(hit[-1]) + 1) if len(hit) else (0, 0, 0)
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -MISMATCH))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.argmin(total[: end + 1]))
    return int(same[begin:end].sum()), a + shift + begin, a + shift + end


def enough(equal: int, stretch: int, item: int) -> bool:
    return equal > 0 and equal >= min(MIN_EQUAL, MIN_ITEM_SHARE * item) and equal >= MIN_IDENTITY * stretch


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of items with windows of texts; shift: the place of the item's first token in the text."""
    for batch in batches:
        keep, rows = [], []
        for k, (item, window, shift) in enumerate(zip(*(batch.column(c) for c in ("item", "window", "shift")), strict=True)):
            item, window, shift = item.values.to_numpy(), window.values.to_numpy(), shift.as_py()
            equal, begin, end = measured(item, window, min(shift, 0))
            if enough(equal, end - begin, len(item)):
                keep.append(k)
                rows.append((equal, len(item), begin + max(shift, 0), end + max(shift, 0)))
        if keep:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("version", "q")] + [pa.array(c, pa.int32()) for c in cols], ["version", "q", "n_equal", "n_item", "begin", "end"])


def _best() -> Column:
    return F.max_by(F.struct("n_equal", "n_item", "begin", "end"), F.struct("n_equal", -F.col("begin"), -F.col("end"))).alias("b")


def of_texts(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlaps of different texts with different items (version, a hash of the text; q, one of the item; b: n_equal, n_item, begin, end);
    the documents that may have one (doc_id, version), and the items (item_id, q)."""
    spark = documents.sparkSession
    items = only(benchmark, "item_id", "text").mapInArrow(tidy(_items), "item_id long, item array<long>, seeds array<struct<seed:long,at:int>>")
    items = saved(items.withColumn("q", F.xxhash64("item")))
    own = saved(items.groupBy("q").agg(F.first("item").alias("item"), F.first("seeds").alias("seeds")))
    lengths = tuple(sorted(r.n for r in own.select(F.size("item").alias("n")).where(f"n between 1 and {SHORT - 1}").distinct().collect()))  # at most SHORT - 1 rows
    short = short_masks(lengths)
    keys = own.select("q", F.explode("seeds").alias("s")).select("q", "s.seed", F.col("s.at").alias("item_at"))
    # Each seed sets two bits of the filter; its size is fixed.
    both = keys.select(F.explode(F.array("seed", F.shiftrightunsigned("seed", 32))).alias("seed"))
    shared = spark.sparkContext.broadcast(bitset(both, "seed", FILTER_BITS))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for i, j, part, off in K.blocks(*K.column(batch, "text")):
                h, d = K.words(part, off)
                counts = np.bincount(d, minlength=j - i)
                cuts = np.concatenate(([0], np.cumsum(counts)))
                found = [(np.zeros(0, K.U64), np.zeros(0, np.int64))]
                for s, at in seeds(h, d, counts, short):
                    ok = has(wanted, s, FILTER_BITS)
                    ok[ok] = has(wanted, s[ok] >> K.U64(32), FILTER_BITS)
                    found.append((s[ok], at[ok]))
                seed, at = map(np.concatenate, zip(*found, strict=True))
                ks, owner = np.unique(d[at], return_inverse=True)
                if len(ks):
                    texts = K.lists(np.concatenate([h[cuts[k] : cuts[k + 1]] for k in ks]).view(np.int64), np.concatenate(([0], np.cumsum(counts[ks]))))
                    ids, versions = (batch.column(c).slice(i, j - i).take(pa.array(ks)) for c in ("doc_id", "version"))
                    yield pa.RecordBatch.from_arrays([ids, versions, texts, _listed(seed, at - cuts[d[at]], owner, len(ks))], ["doc_id", "version", "tokens", "hits"])

    texts = only(documents, "doc_id", "text").withColumn("version", F.xxhash64("text"))
    found = saved(texts.mapInArrow(tidy(hits), "doc_id long, version long, tokens array<long>, hits array<struct<seed:long,at:int>>"))
    once = found.dropDuplicates(["version"])
    pairs = once.select("version", F.explode("hits").alias("h")).select("version", "h.seed", "h.at")
    pairs = pairs.join(small(keys), "seed").select("version", "q", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = pairs.join(small(own.select("q", "item")), "q")
    # Of a text only the window beside the item goes on, so a long text isn't copied for each of its hits.
    window = F.slice("tokens", F.greatest("shift", F.lit(0)) + 1, F.greatest(F.size("item") + F.least("shift", F.lit(0)), F.lit(0)))
    pairs = pairs.join(once.select("version", "tokens"), "version").select("version", "q", "item", "shift", window.alias("window"))
    good = pairs.mapInArrow(tidy(_verify), "version long, q long, n_equal int, n_item int, begin int, end int")
    return saved(good.groupBy("version", "q").agg(_best())), found.select("doc_id", "version"), items.select("item_id", "q")


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_equal, n_item, begin, end: the best overlap of each contaminated text with each item.
    documents has doc_id (long) and text, benchmark item_id (long) and text; begin and end count tokens."""
    good, found, items = of_texts(documents, benchmark)
    named = found.join(small(good), "version").join(small(items), "q").select("doc_id", "item_id", "b.*")
    return named.groupBy("doc_id", "item_id").agg(_best()).select("doc_id", "item_id", "b.*")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """version: hashes (xxhash64) of the texts that overlap with an item."""
    return of_texts(documents, benchmark)[0].select("version").distinct()


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
