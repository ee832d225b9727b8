"""Language identification with bit-sliced Bloom filters of n-grams.

One filter table serves all languages: each slot holds a bitmask with one bit for each
language, so a look-up of an n-gram is the AND of a few slots and names every language
whose common n-grams include it.  A text's n-grams give a count of set bits for each
language; the counts are corrected for the false positives that each language's filter
makes at its fill, and the largest decides.

What enters a filter is every n-gram with a share of at least MIN_SHARE of a language's
n-grams, over all learning rows; so there are at most 1 / MIN_SHARE for each language.

Nulls and texts without a letter are `und`, with a score of 0.  Ties go to the first name.
Texts none of whose n-grams is known get the language with the most learning n-grams.  A text of any
length counts whole.  Repeated rows get equal results, one row each; rows with a null doc_id too.
With nothing to learn from, all is `und`.  An empty table gives no rows.  Other columns, of whatever
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import fold, gathered, only, saved, table, tidy

N = 4  # bytes of an n-gram; letters in lower case, everything else one space
MIN_SHARE, MIN_COUNT = 1e-5, 2
SLOT_BITS, HASHES = 20, 2
HELD = 1 << 22  # n-grams counted at once


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as integers, in the order of the text, and their documents.  None spans two documents, and none
    holds two spaces in a row or only one letter's byte."""
    low = K.lower_latin(raw)
    letter = K._WORD[low]
    text = np.where(letter, low, 0x20).astype(np.uint32)
    if len(text) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    m = len(text) - N + 1
    out = np.zeros(m, np.uint32)
    ok = np.ones(m, bool)
    for k in range(N):
        out = (out << np.uint32(8)) | text[k : k + m]
        if k:
            ok &= letter[k - 1 : k - 1 + m] | letter[k : k + m]
    d = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok &= d[:m] == d[N - 1 :]
    return out[ok], d[:m][ok]


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = K.mix(g.astype(K.U64) + K.U64(0x5851F42D4C957F2D))
    return [((h >> K.U64(24 * k)) & K.U64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """names: languages, in order; masks: for each 8 of them a table of slots; rate: false positives; first: most frequent."""

    names: list[str]
    masks: list[np.ndarray]
    rate: np.ndarray
    first: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, j, part, off in K.blocks(*K.column(batch, "text")):
            g, d = grams(part, off)
            mine = langs[i:j]
            for lang in set(mine):
                held.setdefault(lang, []).append(g[(mine == lang)[d]])
            size += len(g)
            if size >= HELD:
                yield from told()
                held, size = {}, 0
    yield from told()


def fit(documents: DataFrame) -> Model:
    """Learns from the columns text and lang of all rows that have both."""
    rows = documents.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(tidy(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row for each language
    names = sorted(totals)
    if not names:
        return Model([], [], np.zeros(0), 0)
    least = F.create_map(*(F.lit(x) for k in names for x in (k, max(MIN_COUNT, MIN_SHARE * totals[k]))))
    number = F.create_map(*(F.lit(x) for k, name in enumerate(names) for x in (name, k)))
    langs, common = gathered(counts.where(F.col("n") >= least[F.col("lang")]).select(number[F.col("lang")].alias("k"), "gram"), "k", "gram")  # at most 1 / MIN_SHARE rows for each language
    masks = [np.zeros(1 << SLOT_BITS, np.uint8) for _ in range(0, len(names), 8)]
    fill = np.zeros(len(names))
    for k in range(len(names)):
        for slot in _slots(common[langs == k]):
            masks[k // 8][slot] |= np.uint8(1 << k % 8)
        fill[k] = (masks[k // 8] >> k % 8 & 1).mean()
    return Model(names, masks, fill**HASHES, max(range(len(names)), key=lambda k: (totals[names[k]], -k)))


def counted(m: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each document, and for each document and language how many are in the language, corrected."""
    g, d = grams(raw, offsets)
    n = np.bincount(d, minlength=len(offsets) - 1)
    cuts = np.searchsorted(d, np.arange(len(n)))
    out = np.zeros((len(n), len(m.names)))
    slots = _slots(g)
    some = n > 0
    for w, mask in enumerate(m.masks):
        found = mask[slots[0]]
        for s in slots[1:]:
            found &= mask[s]
        for k in range(w * 8, min(len(m.names), w * 8 + 8)):
            if len(g):
                bits = (found >> np.uint8(k % 8)) & np.uint8(1)
                out[some, k] = np.add.reduceat(bits, cuts[some], dtype=np.int64)
    return n, np.maximum((out - n[:, None] * m.rate) / (1 - m.rate), 0)


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """documents with the columns lang_pred and score: the decided language's share of all corrected counts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a byte for each slot and 8 languages
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = K.column(batch, "text")
            found, scores = [], []
            for _, _, part, off in K.blocks(raw, offsets):
                _, c = counted(m, part, off)
                total = c.sum(1)
                ascii_letter = np.concatenate(([0], np.cumsum((part | 0x20 >= 0x61) & (part | 0x20 <= 0x7A) & (part < 0x80))))
                any_ascii = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for k in range(len(off) - 1):
                    if not m.names or not (any_ascii[k] or any(map(str.isalpha, part[off[k] : off[k + 1]].tobytes().decode()))):
                        found.append("und")
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(c[k])) if total[k] > 0 else m.first
                        found.append(m.names[best])
                        scores.append(float(min(1.0, c[k, best] / total[k])) if total[k] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return documents.mapInArrow(tidy(run), ", ".join(f"`{k}` {t}" for k, t in documents.dtypes) + ", lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; learnt from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held))
    out = predicted(only(docs, "doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
