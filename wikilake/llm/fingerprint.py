"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up.  On each level runs of an equal name are joined; then
deterministic coin tossing (the lowest bit in which a name differs from its left
neighbour, four times over) gives each name a label from a handful, different from its
neighbours'; local maxima of the labels begin phrases, and a phrase's name is a hash of
the names in it.  A cut depends on a few names around it only, so equal substrings have
the same phrases inside, wherever they stand.  The fingerprint is of the names of long phrases, or
of shorter ones for a text with few of them; the k-th occurrence of a name counts as a name of its own, so a
repeated passage weighs as much as it is long.  It keeps the smallest hashes, and all below a
fixed share of their range, so it grows with the text.

Nulls and empty texts have an empty fingerprint, alike to each other.  A text of any length is parsed
whole.  Equal texts have equal fingerprints, whatever stands beside them.  Documents follow each other by doc_id,
those without one first, and by text where they share one; repeated rows are each told, one row each.
An empty table gives no rows; a single document is followed by itself.  Other columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import only, table, tidy

#: Coin tosses on a level; levels; the first level of the fine and of the coarse names, and how many of each are kept.
TOSSES, LEVELS, FINE, COARSE, KEEP_FINE, KEEP_COARSE = 4, 8, 1, 3, 32, 48
#: Fewer coarse names than this, and a text has fine ones too.
LEAST = 12
#: All hashes (of 32 bits) up to this are kept.
ALWAYS = (1 << 27) - 1


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels: twice the lowest differing bit's number, plus that bit.  A document's first name differs in bit 0 from nothing."""
    d = np.empty_like(x)
    d[1:] = x[1:] ^ x[:-1]
    d[first] = 1
    low = np.bitwise_count((d & (~d + K.U64(1))) - K.U64(1)).astype(K.U64)
    return K.U64(2) * low + ((x >> low) & K.U64(1))


def _parse(x: np.ndarray, d: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and their documents."""
    n = len(x)
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n)).astype(K.U64)
    x, d = x[at], d[at]
    many = run > 1
    x[many] = K.mix(x[many] + run[many] * K.U64(0x9E3779B97F4A7C15))
    n = len(x)
    first = np.ones(n, bool)
    first[1:] = d[1:] != d[:-1]
    label = x
    for _ in range(TOSSES):
        label = _toss(label, first)
    label = label.astype(np.int8)
    cut = first.copy()
    if n > 2:
        top = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        cut[1:-1] |= top & ~first[2:]
    s = np.flatnonzero(cut)
    e = np.append(s[1:], n)
    cum = np.zeros(n + 1, K.U64)
    np.cumsum(K.mix(x) * K._power(K._P, n)[:n], out=cum[1:])
    names = (cum[e] - cum[s]) * K._power(K._P_INV, n)[s]
    return K.mix(names ^ K.U64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))), d[s]


def _kept(names: list[np.ndarray], docs: list[np.ndarray], n_docs: int, keep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes that each document keeps, ascending, and how many names it has.  Each occurrence of a name has a hash of its own."""
    if not names:
        return [np.zeros(0, K.U64)] * n_docs, np.zeros(n_docs, np.int64)
    x, d = np.concatenate(names), np.concatenate(docs)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    at = np.arange(len(x))
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    h, cuts = K.sets(K.mix(x + again.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) >> K.U64(32), d, n_docs)
    low = np.add.reduceat(np.append(h <= K.U64(ALWAYS), False).astype(np.int64), cuts[:-1]) * (np.diff(cuts) > 0) if n_docs else cuts[:0]
    return [h[cuts[k] : min(cuts[k + 1], cuts[k] + max(keep, int(low[k])))] for k in range(n_docs)], np.diff(cuts)


def sketches(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coarse, fine) hashes of 32 bits of each document's phrase names, ascending; fine ones for texts with few coarse names."""
    n = len(offsets) - 1
    x, d = raw.astype(K.U64) + K.U64(1), np.repeat(np.arange(n), np.diff(offsets))
    levels = []
    for level in range(1, LEVELS + 1):
        if level > 1 and len(x):  # a text that is one name has no more levels
            more = np.bincount(d, minlength=n)[d] > 1
            x, d = x[more], d[more]
        if not len(x):
            break
        x, d = _parse(x, d, level)
        levels.append((x, d))
    coarse, count = _kept([x for x, _ in levels[COARSE - 1 :]], [d for _, d in levels[COARSE - 1 :]], n, KEEP_COARSE)
    few = count < LEAST
    fine, _ = _kept([x[few[d]] for x, d in levels[FINE - 1 :]], [d[few[d]] for _, d in levels[FINE - 1 :]], n, KEEP_FINE)
    return list(zip(coarse, fine, strict=True))


def written(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    return ".".join(x.astype(">u4").tobytes().hex() for x in sketch)


def _reach(x: np.ndarray, keep: int) -> int:
    """The hash up to which a sketch has all."""
    return (1 << 32) - 1 if len(x) < keep else max(ALWAYS, int(x[-1]))


def _alike(a: np.ndarray, b: np.ndarray, keep: int) -> float:
    """Jaccard similarity of two sets, from what both sketches reach."""
    top = min(_reach(a, keep), _reach(b, keep))
    a, b = a[a <= top], b[b <= top]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: by the fine names of two short texts, else by the coarse ones.  Two empty fingerprints are alike."""
    if len(a[1]) and len(b[1]) or not len(a[0]) + len(b[0]):
        return _alike(a[1], b[1], KEEP_FINE)
    return _alike(a[0], b[0], KEEP_COARSE)


def _of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    data = pa.array(texts, pa.large_string())
    raw, offsets = K.column(pa.RecordBatch.from_arrays([data], ["t"]), "t")
    return [s for _, _, part, off in K.blocks(raw, offsets) for s in sketches(part, off)]


def fingerprinted(documents: DataFrame) -> DataFrame:
    """documents with a column fingerprint; one pass without a shuffle."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.column(batch, "text")
            found = [written(s) for _, _, part, off in K.blocks(raw, offsets) for s in sketches(part, off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, "fingerprint"])

    return documents.mapInArrow(tidy(run), ", ".join(f"`{k}` {t}" for k, t in documents.dtypes) + ", fingerprint string")


def _dealt(documents: DataFrame) -> DataFrame:
    """Rows (bucket, late, doc_id, text): doc_id ranges; each bucket ends with the first document after it, marked late.

    The texts are shuffled once; only as many ids as there are buckets reach the driver."""
    spark = documents.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = documents.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("c")).first().c or []
    bounds = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda b: b < F.col("doc_id")))
    rows = documents.withColumn("bucket", bucket)
    first = F.when(F.bool_or(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id"))
    firsts = [(r.bucket, r.first) for r in documents.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(first.alias("first")).orderBy("bucket").collect()]  # a row for each bucket
    back = [(firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]  # the very first goes to the last bucket
    to = F.broadcast(spark.createDataFrame(back, "first long, back int"))  # a row for each bucket
    rows = rows.join(to, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    both = F.array(F.struct("bucket", F.lit(False).alias("late")), F.struct(F.col("back").alias("bucket"), F.lit(True).alias("late")))
    rows = rows.withColumn("to", F.explode(F.filter(both, lambda x: x.bucket.isNotNull()))).select("to.bucket", "to.late", "doc_id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "late", "doc_id", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []  # bucket, late, doc_id, text; the last waits for what follows it
    marks: list = []

    def told(last: bool) -> pa.RecordBatch:
        n = len(rows) if last else len(rows) - 1
        marks.extend(_of([r[3] for r in rows[len(marks) :]]))
        pick = [k for k in range(n) if not rows[k][1] and k + 1 < len(rows) and rows[k + 1][0] == rows[k][0]]
        texts = []
        for k in pick:
            t = rows[k][3]
            q = len(t) // 4
            texts.append(t[: len(t) - q] + rows[k + 1][3][:q])
        new = _of(texts)
        out = [
            pa.array([rows[k][2] for k in pick], pa.int64()),
            pa.array([len(rows[k][3]) for k in pick], pa.int64()),
            pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array([written(marks[k]) for k in pick], pa.string()),
            pa.array([written(m) for m in new], pa.string()),
            pa.array([likeness(marks[k], m) for k, m in zip(pick, new, strict=True)], pa.float64()),
            pa.array([likeness(marks[k], marks[k + 1]) for k in pick], pa.float64()),
        ]
        del rows[:n], marks[:n]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        for b, late, i, t in zip(*(batch.column(c) for c in ("bucket", "late", "doc_id", "text")), strict=True):
            rows.append((b.as_py(), late.as_py(), i.as_py(), t.as_py() or ""))
            size += len(rows[-1][3])
            if size > K.BLOCK and len(rows) > 1:
                yield told(False)
                size = len(rows[0][3])
    if rows:
        yield told(True)


def compared(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last quarter replaced by the beginning of the next
    document, by doc_id), and how alike these and the next document's are."""
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(only(documents, "doc_id", "text")).mapInArrow(tidy(_edited), kinds)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compared(table(spark, sf_dir, "documents"))
