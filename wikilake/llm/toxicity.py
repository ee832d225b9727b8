"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is embedded as the sum of three hashed rows: two of the whole word, so that a
chance collision in one table row is not enough to look like another word, and one of
its first letters, so that unseen inflections of a known stem are near it.  Filters of
widths one to three run over the whole text, max pooling keeps each filter's strongest
answer, and a logistic unit decides.  Training takes all labelled rows, on the executors:
in a round every task takes gradient steps on about TASK_WORDS words from the weights that all
share and passes on the rows that it changed; their changes are averaged row by row on the executors, and the
driver gets one table of the weights' fixed size.  Thresholds come from all labelled rows, too: each half of
them, by a hash of the text, is scored by a model of the other half.  Scoring is one pass over the texts.

Nulls, empty texts and texts without a letter are scored like a text without words:
the pooled value of the padding.  A text of any length is scored whole.  Repeated rows get equal scores, one row
each; rows with a null doc_id too.  Where rows that share a doc_id have different texts, all of them are learnt from
with that id's label; an id with tied labels is toxic.  With no labelled row of one of the two classes, every
score is 0.  An empty table gives no rows.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import SMALL, bitset, fold, gathered, give_back, has, only, saved, table, tidy

WORD_BITS, STEM_BITS, STEM_BYTES, DIM, WIDTHS, FILTERS = 18, 16, 5, 8, (1, 2, 3), 8
PAD = max(WIDTHS)
TABLE = (1 << WORD_BITS) + (1 << STEM_BITS)  # rows of both tables of embeddings
#: Words that a task learns from in a round, about; words that it holds at once, to mix their texts.
TASK_WORDS, POOL_WORDS = 6_000_000, 12_000_000
CHUNK = 1 << 10  # rows of a chunk of weights
CUT = 0.7
CUTS = np.linspace(0.3, 0.9, 61)
EPOCHS, STEPS, BATCH = 6, 300, 48
SQUARES = 1e-3  # what the sums of squared gradients begin with


@dataclass
class Model:
    """Weights.  `flat` means that there was nothing to learn from."""

    word: np.ndarray
    stem: np.ndarray
    conv: list[np.ndarray]  # for width w: (w, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    flat: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three row numbers of each word packed into 64 bits, and the words of each document."""
    h, stem, d = K.letter_words(raw, offsets, STEM_BYTES)
    w = K.U64(WORD_BITS)
    packed = (h >> K.U64(64 - WORD_BITS)) | ((h & K.U64((1 << WORD_BITS) - 1)) << w) | ((stem >> K.U64(64 - STEM_BITS)) << K.U64(2 * WORD_BITS))
    return packed, np.bincount(d, minlength=len(offsets) - 1)


def _rows(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = (1 << WORD_BITS) - 1
    p = packed.astype(np.int64)
    return p & m, (p >> WORD_BITS) & m, (p >> 2 * WORD_BITS) & ((1 << STEM_BITS) - 1)


def _padded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where each word goes, the first row and the row after the last window of each document, all rows."""
    first = np.concatenate(([0], np.cumsum(n + PAD)))
    at = np.arange(int(n.sum())) + np.repeat(PAD * np.arange(len(n)), n)
    return at, first[:-1], first[:-1] + n + 1, int(first[-1])


def _convolve(m: Model, x: np.ndarray) -> np.ndarray:
    """Answers of all filters for the window that begins at each row."""
    out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        y = x @ m.conv[i][0]
        for j in range(1, w):
            y[:-j] += x[j:] @ m.conv[i][j]
        out[:, i * FILTERS : (i + 1) * FILTERS] = y
    return out


def _embed(m: Model, packed: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    a, b, s = _rows(packed)
    x = np.zeros((total, DIM), np.float32)
    x[at] = m.word[a] + m.word[b] + m.stem[s]
    return x


def _pool(y: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    cuts = np.stack((first, last), 1).ravel()
    return np.maximum.reduceat(y, cuts, axis=0)[::2]


def score(m: Model, packed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scores (0 to 1) of documents with n words each."""
    if m.flat or not len(n):
        return np.zeros(len(n))
    at, first, last, total = _padded(n)
    pooled = np.maximum(_pool(_convolve(m, _embed(m, packed, at, total)), first, last) + m.bias, 0)
    return 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -30, 30).astype(np.float64)))


def _nothing() -> Model:
    return Model(np.zeros((1, DIM), np.float32), np.zeros((1, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, flat=True)


def _occurrences(texts: Iterable[tuple[np.ndarray, int]]) -> np.ndarray:
    """The number of texts of either class that have each row of the tables, the rows of the stems last."""
    seen = np.zeros((2, TABLE), np.int64)
    for t, k in texts:
        a, b, s = _rows(t)
        seen[k][np.unique(np.concatenate((a, b)))] += 1
        seen[k][np.unique(s) + (1 << WORD_BITS)] += 1
    return seen


def _begin(seen: np.ndarray, clean: int, toxic: int, rng: np.random.Generator) -> Model:
    """Small random weights; the first coordinate of a row begins as its smoothed log odds."""
    word = rng.normal(0, 0.05, (1 << WORD_BITS, DIM)).astype(np.float32)
    stem = rng.normal(0, 0.05, (1 << STEM_BITS, DIM)).astype(np.float32)
    odds = np.clip(np.log((seen[1] / toxic + 2e-3) / (seen[0] / clean + 2e-3)), -0.5, 2.5)
    word[:, 0], stem[:, 0] = odds[: 1 << WORD_BITS], odds[1 << WORD_BITS :]
    conv = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for c in conv:
        c[:, 0, :2] += 0.5
    n = FILTERS * len(WIDTHS)
    return Model(word, stem, conv, np.zeros(n, np.float32), np.full(n, 0.1, np.float32), -1.0)


def _squares(m: Model) -> Model:
    """The sums of squared gradients of each weight, which set its step size; they have a model's shape."""
    word, stem, *conv, bias, out = (np.full(p.shape, SQUARES, np.float32) for p in (m.word, m.stem, *m.conv, m.bias, m.out))
    return Model(word, stem, conv, bias, out, SQUARES)


def _weight(clean: int, toxic: int) -> np.ndarray:
    """What a row of either class counts."""
    return np.sqrt(0.5 * (clean + toxic) / np.array([clean, toxic]))


def _step(p: np.ndarray, power: np.ndarray, g: np.ndarray, rate: float, at=slice(None)) -> None:
    power[at] += g * g
    p[at] -= rate * g / np.sqrt(power[at])


def _descend(m: Model, power: Model, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int) -> None:
    """Gradient steps on the texts in this order, in place; gradients pass max pooling only at the strongest window."""
    for i in range(0, len(order), batch):
        pick = order[i : i + batch]
        n = np.array([len(texts[k]) for k in pick])
        packed = np.concatenate([texts[k] for k in pick])
        at, first, last, total = _padded(n)
        x = _embed(m, packed, at, total)
        answers = _convolve(m, x)
        top = _pool(answers, first, last)
        best = np.empty(top.shape, np.int64)
        for k in range(len(pick)):
            best[k] = first[k] + np.argmax(answers[first[k] : last[k]], axis=0)
        pooled = np.maximum(top + m.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -30, 30)))
        g = ((p - y[pick]) * weight[y[pick]] / len(pick)).astype(np.float32)
        back = g[:, None] * m.out * (pooled > 0)
        dx = np.zeros_like(x)
        for f, w in enumerate(WIDTHS):
            cols = slice(f * FILTERS, (f + 1) * FILTERS)
            gb, at0 = back[:, cols], best[:, cols]
            grad = np.empty_like(m.conv[f])
            for j in range(w):
                grad[j] = np.einsum("bf,bfd->df", gb, x[at0 + j])
                np.add.at(dx, (at0 + j).ravel(), (gb[:, :, None] * m.conv[f][j].T[None]).reshape(-1, DIM))
            _step(m.conv[f], power.conv[f], grad + 1e-5 * m.conv[f], 0.03)
        _step(m.bias, power.bias, back.sum(0), 0.03)
        gb = float(g.sum())
        power.out_bias += gb * gb
        m.out_bias -= 0.1 * gb / power.out_bias**0.5
        _step(m.out, power.out, pooled.T @ g, 0.1)
        hit = np.flatnonzero(np.any(dx[at], axis=1))
        a, b, s = _rows(packed[hit])
        for rows, sums, where in ((m.word, power.word, np.concatenate((a, b))), (m.stem, power.stem, s)):
            grads = np.concatenate((dx[at[hit]],) * (len(where) // max(1, len(hit)))) if len(hit) else dx[:0]
            u, inv = np.unique(where, return_inverse=True)
            total_g = np.zeros((len(u), DIM), np.float32)
            np.add.at(total_g, inv, grads)
            _step(rows, sums, total_g + 1e-5 * rows[u], 0.05, u)


def epochs_of(n: int, batch: int = BATCH) -> int:
    """EPOCHS, or more for few texts: STEPS steps at least."""
    return max(EPOCHS, -(-STEPS * batch // max(1, n)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int | None = None, batch: int = BATCH, seed: int = 7) -> Model:
    """A model of texts at hand, by gradient descent with per-weight step sizes.  Without a number of epochs it takes epochs_of."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return _nothing()
    clean, toxic = int((y == 0).sum()), int((y == 1).sum())
    m = _begin(_occurrences(zip(texts, y, strict=True)), clean, toxic, rng)
    power = _squares(m)
    for _ in range(epochs or epochs_of(len(y), batch)):
        _descend(m, power, texts, y, _weight(clean, toxic), rng.permutation(len(y)), batch)
    return m


# --- learning from tables ----------------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the text, and its packed words."""
    for batch in batches:
        raw, offsets = K.column(batch, "text")
        others = [k for k in batch.schema.names if k != "text"]
        for i, j, part, off in K.blocks(raw, offsets):
            packed, n = features(part, off)
            cuts = np.concatenate(([0], np.cumsum(n)))
            rows = [packed[cuts[k] : cuts[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in others), pa.array(rows, pa.binary())], [*others, "words"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for w, k in zip(batch.column("words"), batch.column("toxic").to_pylist(), strict=True):
            yield np.frombuffer(w.as_py(), np.uint64), k


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """half, toxic, lang and packed words of every labelled row, saved: dealt by a hash, in an order that doesn't depend on the files.
    Rows that share a text are in the same half."""
    marked = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    docs = only(documents, "doc_id", "lang", "text").where("doc_id is not null")
    if n <= SMALL:
        rows = docs.join(F.broadcast(marked), "doc_id").repartition("doc_id")
    else:  # of the texts only those that may have a label are shuffled
        bits = min(28, max(23, int(8 * n).bit_length()))
        known = documents.sparkSession.sparkContext.broadcast(bitset(marked.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "h", bits))  # 2**28 bits at most

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has(known.value, batch.column("h").to_numpy().view(np.uint64), bits))).drop_columns(["h"])

        kinds = ", ".join(f"`{k}` {t}" for k, t in docs.dtypes)
        rows = docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).mapInArrow(tidy(likely), kinds).join(marked.hint("shuffle_merge"), "doc_id")
    place, half = F.xxhash64("doc_id", "text"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    rows = rows.withColumn("place", place).sortWithinPartitions("place", "lang").select(half.alias("half"), "toxic", "lang", "text")
    return saved(rows.mapInArrow(tidy(_packed), "half int, toxic int, lang string, words binary"), least=1 << 30)


def _flat(m: Model) -> np.ndarray:
    """The weights beside the embeddings."""
    return np.concatenate([x.ravel() for x in (*m.conv, m.bias, m.out)] + [np.array([m.out_bias])]).astype(np.float64)


def _put(m: Model, flat: np.ndarray) -> None:
    """Adds to the weights beside the embeddings."""
    i = 0
    for x in (*m.conv, m.bias, m.out):
        x += flat[i : i + x.size].reshape(x.shape).astype(np.float32)
        i += x.size
    m.out_bias += float(flat[i])


def _changed(new: tuple[Model, Model], old: tuple[Model, Model]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of the tables: its number, the rows that changed, and the changes of their embeddings and sums of squares."""
    for c in range(TABLE // CHUNK):
        first = c * CHUNK
        name, first = ("word", first) if first < 1 << WORD_BITS else ("stem", first - (1 << WORD_BITS))
        at = slice(first, first + CHUNK)
        diff = np.concatenate([getattr(a, name)[at] - getattr(b, name)[at] for a, b in zip(new, old, strict=True)], 1)
        hit = np.flatnonzero(diff.any(1))
        if len(hit):
            yield c, hit.astype(np.int32), diff[hit]


def _copy(m: Model) -> Model:
    return Model(m.word.copy(), m.stem.copy(), [x.copy() for x in m.conv], m.bias.copy(), m.out.copy(), m.out_bias)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row of the chunks that this task has, over the tasks that changed it.  What comes is
    sorted by chunk and task, so that sums don't depend on who was first."""
    now, sums, n = None, np.zeros(0), np.zeros(0)

    def told() -> pa.RecordBatch:
        rows = np.flatnonzero(n).astype(np.int32)
        value = (sums[rows] / n[rows, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([rows.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], ["chunk", "rows", "value"])

    for batch in batches:
        for chunk, rows, value in zip(batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("value"), strict=True):
            rows = np.frombuffer(rows.as_py(), np.int32)
            value = np.frombuffer(value.as_py(), np.float32).reshape(len(rows), -1)
            if chunk != now:
                if now is not None:
                    yield told()
                now, sums, n = chunk, np.zeros((CHUNK, value.shape[1])), np.zeros(CHUNK)
            sums[rows] += value
            n[rows] += 1
    if now is not None:
        yield told()


def trained(rows: DataFrame, seed: int = 7) -> Model:
    """A model of all rows of a saved table with the columns toxic and words."""
    sc = rows.sparkSession.sparkContext
    sizes = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("b")).collect()}  # two rows
    if len(sizes) < 2:
        return _nothing()
    clean, toxic = sizes[0].n, sizes[1].n
    tasks = max(1, -(-(sizes[0].b + sizes[1].b) // (8 * TASK_WORDS)))
    rows = rows.select("toxic", "words").coalesce(tasks)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _occurrences(_texts(batches))
        k = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[0, k]), pa.array(seen[1, k])], ["k", "clean", "toxic"])

    sums = rows.mapInArrow(tidy(occurrences), "k long, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    k, *counts = gathered(sums, "k", "clean", "toxic")  # at most TABLE rows
    seen = np.zeros((2, TABLE), np.int64)
    seen[:, k] = counts
    m = _begin(seen, clean, toxic, np.random.default_rng(seed))
    power, weight = _squares(m), _weight(clean, toxic)
    rounds = EPOCHS if tasks > 1 else 1
    passes = -(-epochs_of(clean + toxic) // rounds)
    for r in range(rounds):
        shared = sc.broadcast((m, power))  # TABLE rows of 2 * DIM weights

        def changes(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, r, task])
            old = shared.value
            new, squares = _copy(old[0]), _copy(old[1])
            texts, y, held, any_ = [], [], 0, False

            def learn() -> None:
                for _ in range(passes):
                    _descend(new, squares, texts, np.array(y), weight, rng.permutation(len(y)), BATCH)

            for t, k in _texts(batches):
                texts.append(t)
                y.append(k)
                held += len(t)
                if held >= POOL_WORDS:
                    learn()
                    texts, y, held, any_ = [], [], 0, True
            if texts:
                learn()
            elif not any_:
                return
            texts.clear()
            flat = np.concatenate([_flat(a) - _flat(b) for a, b in zip((new, squares), old, strict=True)]).astype(np.float32)
            told = chain([(-1, np.zeros(1, np.int32), flat)], _changed((new, squares), old))
            for chunk, where, value in told:
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([task]), pa.array([where.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], ["chunk", "task", "rows", "value"])

        own = rows.mapInArrow(tidy(changes), "chunk long, task long, rows binary, value binary")
        means = own.repartition(min(64, TABLE // CHUNK), "chunk").sortWithinPartitions("chunk", "task").mapInArrow(tidy(_averaged), "chunk long, rows binary, value binary")
        for x in means.collect():  # the size of the weights
            at = np.frombuffer(x.rows, np.int32).astype(np.int64)
            value = np.frombuffer(x.value, np.float32).reshape(len(at), -1)
            if x.chunk < 0:
                for model, flat in zip((m, power), np.split(value[0].astype(np.float64), 2), strict=True):
                    _put(model, flat)
                continue
            at += x.chunk * CHUNK
            stem = at >= 1 << WORD_BITS
            for model, part in zip((m, power), (value[:, :DIM], value[:, DIM:]), strict=True):
                model.word[at[~stem]] += part[~stem]
                model.stem[at[stem] - (1 << WORD_BITS)] += part[stem]
        shared.destroy()
        give_back(rows.sparkSession)
    return m


def calibrate(counts: list[tuple[int, int, int]]) -> float:
    """The middle of the cuts with the best F1 for (toxic, cuts reached, rows)."""
    reached = np.zeros((2, len(CUTS) + 1))
    for k, j, n in counts:
        reached[k, j] += n
    above = reached[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * above[1] / (above.sum(0) + reached[1].sum())
    return float(round(np.median(CUTS[f1 >= f1.max() - 1e-12]), 3))


def thresholds(rows: DataFrame, halves: list[Model], least: int = 8) -> dict[str, float]:
    """For each language with `least` rows of both classes, its cut.  The rows of a half are scored by the model of the other."""
    if any(m.flat for m in halves):
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, out = batch.column("half").to_numpy(), np.zeros(len(batch), np.int64)
            for i, (t, _) in enumerate(_texts([batch])):
                out[i] = np.searchsorted(CUTS, score(shared.value[1 - half[i]], t, np.array([len(t)]))[0], "right")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(out)], ["lang", "toxic", "cuts"])

    n = rows.where("lang is not null").mapInArrow(tidy(reached), "lang string, toxic int, cuts long").groupBy("lang", "toxic", "cuts").agg(F.count("*").alias("n"))
    toxic = F.col("toxic") == 1
    known = n.groupBy("lang").agg(F.collect_list(F.struct("toxic", "cuts", "n")).alias("counts"), F.sum(F.when(toxic, F.col("n"))).alias("bad"), F.sum(F.when(~toxic, F.col("n"))).alias("good"))
    out = {r.lang: calibrate(r.counts) for r in known.where(f"bad >= {least} and good >= {least}").collect()}  # a row for each such language
    shared.destroy()
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns weights and thresholds from all labelled documents."""
    rows = labelled(documents, labels)
    m = trained(rows)
    if not m.flat:
        m.thresholds = thresholds(rows, [trained(rows.where(f"half = {k}")) for k in range(2)])
    return m


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents with a column score; one pass, no shuffle."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: (2**18 + 2**16) * 8 floats
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = K.column(batch, "text")
            s = [score(m, *features(part, off)) for _, _, part, off in K.blocks(raw, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], [*names, "score"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in documents.dtypes)
    return documents.mapInArrow(tidy(run), f"{kinds}, score double")


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated cut of a row's language; CUT for others and for null."""
    out = F.lit(CUT)
    for name, cut in model.thresholds.items():
        out = F.when(lang == name, cut).otherwise(out)
    return out


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    m = fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    out = scored(only(docs, "doc_id", "text", "lang"), m)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), threshold(m, F.col("lang")).alias("lang_threshold"), (F.col("score") >= threshold(m, F.col("lang"))).cast("int").alias("lang_predicted"))
