"""Personal data: fixed kinds, and contextual patterns that are bootstrapped from them.

The fixed kinds (e-mail, IP address, card, phone) are the seeds.  Lexical patterns are the one, two or
three words before an instance, the two words after it, and the words on both sides of an instance
of one word.  Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the share of all its occurrences, over the
whole corpus, that stand beside trusted instances; an instance is as good as its best
pattern.  Patterns above a bar then mark identifier-like words that no fixed kind knows;
these spans have the kind `context`.

Nulls and empty texts have no spans.  A text of any length is scanned whole.  Repeated rows get equal results, one row
each; spans follow from the text alone, so rows that share a doc_id, or have none, get those of their own
texts.  Spans of a tied start come in the order of kinds; patterns of a tied score both count.  An empty table
gives no rows and no patterns.  Other columns, of whatever names, are not looked at.  A context span never
overlaps a span of a fixed kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import attach, bitset, has, only, saved, small, table, tidy
from wikilake.llm.spanfind import PERSONAL, find

LEFT, RIGHT = 3, 2  # words of the longest pattern before an instance, and of that after it
ROUNDS = 3
#: A pattern needs this many different seeds, and this score, to be believed.
MIN_SEEDS, MIN_SCORE = 3, 0.8
MIN_DIGITS, MIN_LENGTH = 4, 6  # of an identifier-like word, which has so many digits or an @
HELD = 1 << 22  # occurrences counted at once
KINDS = (*(k for k, _ in PERSONAL), "context")
_TRIM = b"\"'()[]{}<>,.;:!?"
SPANS = "array<struct<start:int,k:int,end:int>>"


EDGES = "array<struct<pattern:long,instance:long,seed:boolean,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))
_EDGES_ARROW = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(kinds, contexts: bool):
    """A function for mapInArrow: one row for each text with its spans of the fixed kinds and, if wanted,
    its candidates: patterns beside seeds and beside identifier-like words that no span covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.column(batch, "text")
            for i, j, part, off in K.blocks(raw, offsets):
                base, edges = [], []
                low = K.lower_ascii(part)
                if contexts:
                    s, e, d = K.spans(~K._SPACE[low], off)
                    h = K.hash_spans(low, s, e)
                    digits = np.concatenate(([0], np.cumsum((low >= 0x30) & (low <= 0x39))))
                    signs = np.concatenate(([0], np.cumsum(low == 0x40)))
                    like = np.flatnonzero(((digits[e] - digits[s] >= MIN_DIGITS) | (signs[e] > signs[s])) & (e - s >= MIN_LENGTH))
                    like_at = np.searchsorted(d[like], np.arange(j - i + 1))
                for k in range(j - i):
                    text = part[off[k] : off[k + 1]].tobytes().decode()
                    spans = find(text, kinds) if text else []
                    base.append([{"start": x, "k": kind, "end": y} for x, kind, y in spans])
                    if not contexts:
                        continue
                    near = like[like_at[k] : like_at[k + 1]]
                    if not spans and not len(near):
                        edges.append([])
                        continue
                    wide = len(text) != off[k + 1] - off[k]
                    byte = (lambda c: int(off[k]) + len(text[:c].encode())) if wide else (lambda c: int(off[k]) + c)  # noqa: B023
                    char = (lambda b: len(part[off[k] : b].tobytes().decode())) if wide else (lambda b: int(b - off[k]))  # noqa: B023
                    taken = [(byte(x), byte(y)) for x, _, y in spans]
                    found = [(int(np.searchsorted(e, x, "right")), int(np.searchsorted(s, y, "left")), int(K.hash_spans(low, np.array([x]), np.array([y]))[0].view(np.int64)), True, c[0], c[2]) for (x, y), c in zip(taken, spans, strict=True)]
                    for w in near.tolist():
                        word = part[s[w] : e[w]].tobytes()
                        x, y = int(s[w]) + len(word) - len(word.lstrip(_TRIM)), int(e[w]) - len(word) + len(word.rstrip(_TRIM))
                        if x < y and all(y <= b or x >= f for b, f in taken):
                            found.append((w, w + 1, int(h[w].view(np.int64)), False, char(x), char(y)))
                    if not found:
                        edges.append([])
                        continue
                    rows = []
                    for p, kept in _patterns(h, d, np.array([f[0] for f in found]), np.array([f[1] for f in found])):
                        rows += [{"pattern": x, "instance": f[2], "seed": f[3], "start": f[4], "end": f[5]} for x, f in zip(p.view(np.int64).tolist(), (found[n] for n in kept.tolist()), strict=True)]
                    edges.append(rows)
                arrays = [pa.array(base, _SPANS_ARROW)]
                if contexts:
                    arrays.append(pa.array(edges, _EDGES_ARROW))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *arrays], [*batch.schema.names, "base", *["edges"] * contexts])

    return run


def spanned(documents: DataFrame, kinds=PERSONAL) -> DataFrame:
    """documents with a column base: the spans of the fixed kinds in the whole text."""
    return documents.mapInArrow(tidy(_scan(kinds, False)), ", ".join(f"`{k}` {t}" for k, t in documents.dtypes) + f", base {SPANS}")


def _patterns(h: np.ndarray, d: np.ndarray, pick: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of pattern (hashes, numbers of instances that have it): one to LEFT words before an instance, one
    to RIGHT after it (only the longest is told), and one on both sides of an instance of one word.  pick: the first word of each
    instance; after: the first word behind it."""
    every = np.arange(len(pick))
    acc, own = np.zeros(len(pick), K.U64), d[np.minimum(pick, len(d) - 1)]
    before = None
    for n in range(1, LEFT + 1):
        ok = pick[every] >= n
        ok[ok] = d[pick[every[ok]] - n] == own[every[ok]]
        every, acc = every[ok], acc[ok]
        acc = K.mix(acc * K.U64(3) + h[pick[every] - n])
        before = before or (acc, every)
        yield acc, every
    there = lambda x, n: (after[x] + n < len(h)) & (d[np.minimum(after[x] + n, len(h) - 1)] == own[x])
    acc, every = before
    ok = there(every, 0)
    ok[ok] = after[every[ok]] == pick[every[ok]] + 1
    acc, every = acc[ok], every[ok]
    yield K.mix(acc * K.U64(5) + h[after[every]] + K.U64(0xB07)), every
    every = np.flatnonzero(there(np.arange(len(pick)), RIGHT - 1))
    acc = np.zeros(len(every), K.U64)
    for n in range(RIGHT):
        acc = K.mix(acc * K.U64(7) + h[after[every] + n] + K.U64(0xAF7E))
    yield acc, every


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), base and edges of documents (doc_id long, text); saved, as it is small beside the texts."""
    texts = only(documents, "doc_id", "text")
    kinds = f"doc_id long, text string, base {SPANS}, edges {EDGES}"
    return saved(texts.mapInArrow(tidy(_scan(PERSONAL, True)), kinds).select("doc_id", F.xxhash64("text").alias("version"), "base", "edges"))


def fit(documents: DataFrame, cands: DataFrame) -> DataFrame:
    """Believed patterns (pattern, score).  cands: candidates() of the documents."""
    spark = documents.sparkSession
    edges = cands.select(F.explode("edges").alias("e")).groupBy("e.pattern", "e.instance", "e.seed").agg(F.count("*").alias("n"))
    edges = saved(edges)
    good = edges.where("seed").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    shared = spark.sparkContext.broadcast(bitset(good, "pattern"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        if not wanted.any():
            return
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

        for batch in batches:
            for _, _, part, off in K.blocks(*K.column(batch, "text")):
                h, d = K.words(part, off)
                if len(h):
                    held += [p[has(wanted, p)] for p, _ in _patterns(h, d, np.arange(len(h)), np.arange(1, len(h) + 1))]
                if sum(map(len, held)) >= HELD:
                    yield told()
                    held = []
        if held:
            yield told()

    seen = documents.select("text").mapInArrow(tidy(totals), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    graph = saved(edges.join(small(saved(good.join(seen, "pattern"))), "pattern"))
    trust = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(ROUNDS):
        scores = graph.join(trust, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("trust")) / (F.max("total") + 1)).alias("score"))
        scores = saved(scores.where(F.col("score") >= MIN_SCORE / 2))
        best = graph.join(small(scores), "pattern").groupBy("instance").agg(F.max("score").alias("best"))
        trust = saved(trust.join(best, "instance", "left").select("instance", F.greatest("trust", F.coalesce("best", F.lit(0.0))).alias("trust")))
    return saved(scores.where(F.col("score") >= MIN_SCORE))


def found(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), base and spans: all spans of every row, by start, then kind.
    documents has doc_id (long) and text; the patterns are learnt from all of its texts."""
    cands = candidates(documents)
    patterns = fit(documents, cands)
    more = cands.select("version", F.explode("edges").alias("e")).where("not e.seed").withColumn("pattern", F.col("e.pattern")).join(small(patterns), "pattern", "left_semi")
    more = saved(more.groupBy("version").agg(F.collect_set(F.struct("e.start", F.lit(len(PERSONAL)).alias("k"), "e.end")).alias("more")))
    return attach(cands.drop("edges"), more, "version", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPANS})"))))).drop("more")


def listed(spans: str, kinds=KINDS):
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.start, ':', x.end)), ',')")


def counted(spans: str, k: int):
    return F.expr(f"cast(size(filter({spans}, x -> x.k = {k})) as long)")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text of documents."""
    out = found(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(counted("base", k).alias(f"n_{n}") for k, (n, _) in enumerate(PERSONAL)), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), counted("spans", len(PERSONAL)).alias("n_context"), F.size("spans").cast("long").alias("n_spans"))


def masked(text: str, spans: str, kinds=KINDS):
    """The text with <KIND> in place of each span; a span that begins within another one extends it."""
    names = ", ".join(f"'<{k.upper()}>'" for k in kinds)
    step = f"""struct(
        if(x.start >= a.at, concat(a.out, substring({text}, a.at + 1, x.start - a.at), element_at(array({names}), x.k + 1)), a.out) as out,
        greatest(a.at, x.end) as at)"""
    return F.expr(f"aggregate({spans}, struct('' as out, 0 as at), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))")
