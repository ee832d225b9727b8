"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Every token, known or not, has a path from its spelling: five bits of a hash of its last bytes
(its class), then bits of a hash of the whole token, five at a time (classes within classes), down
to a cell.  P(token | history) is the product of P(class | history), P(class within | class, history)
and so on, and of the token's share in its cell.  Each choice is a softmax over 32 classes,
taken in five halvings, so that only the path's own logits are computed.  The more distinct
tokens there are, the deeper the paths.

A halving's logit is a fixed unigram part, from the exact counts of all training tokens, plus a
hashed weight for each feature of the history: the last token, the last two together, skips to the
second and third last, and a skip to all that stands before, by the signs of eight random projections
of the endings of those words.  There are more weights the more training tokens there are.  In a
cell the exact counts decide, smoothed by a half, with one place for the unknown.

Training is one pass over all training texts in rounds, the more the more tokens there are.  In a
round every task takes gradient steps on about TASK_TOKENS tokens from the weights that all share and
passes on the change; the changes are averaged row by row on the executors, and the driver gets
one table of at most 2**ROW_BITS[1] rows.  Scores take the weights rounded to 16 bits, to a unit that the largest sets.  Counts of tokens beyond the TOP most frequent are joined, never
collected.

Nulls and empty texts have one token, the end.  A text of any length is scored whole, in one go.  Repeated
rows get equal scores, one row each; rows with a null doc_id too.  Of tokens with tied counts any may be among
the TOP; scores don't depend on it.  With no training text N and V are 0: base_score is 0 for every
token, and so is the model's.  An empty table gives no rows.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.llm import kernels as K
from wikilake.llm.common import fold, frequent, gathered, give_back, only, saved, table, tidy

#: Halvings of a class, levels of classes (least and most), and weights of a row (one for each inner node, and a spare one).
HALVINGS, LEVELS, ROW = 5, (2, 4), 32
#: Features of the history that each level looks at: 0 last token, 1 last two, 2 and 3 skips, 4 skip to all before.
FEATURES = ((0, 1, 2, 3, 4), (0, 1, 4), (0, 1, 4), (0, 4))
ROW_BITS = (12, 18)
RATE, BATCH = 0.1, 4096
SCORED = 8192  # tokens scored at once
#: Tokens with counts on every executor: tables of fixed size; all others are joined.
TOP, SLOT_BITS = 1 << 17, 19
HELD = 1 << 21  # tokens counted at once
TASK_TOKENS = 3_000_000
CHUNK = 1 << 10  # rows of a chunk of weights
END, END_TAIL = K.mix(np.array([0x0E0D, 0x0E0E], K.U64))
_SUFFIX = 2  # bytes


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each document and its end, in order, of their endings, and where each document begins (n + 1)."""
    n = len(offsets) - 1
    low = K.lower_ascii(raw)
    s, e, d = K.spans(~K._SPACE[low], offsets)
    counts = np.bincount(d, minlength=n)
    at = np.concatenate(([0], np.cumsum(counts + 1)))
    h, tail = np.full(at[-1], END, K.U64), np.full(at[-1], END_TAIL, K.U64)
    where = np.arange(len(s)) + d
    h[where] = K.hash_spans(low, s, e)
    tail[where] = K.mix(K.hash_spans(low, np.maximum(s, e - _SUFFIX), e))
    return h, tail, at


def _class(tail: np.ndarray) -> np.ndarray:
    return (tail >> K.U64(64 - HALVINGS)).astype(np.int64)


def paths(h: np.ndarray, tail: np.ndarray, depth: int) -> np.ndarray:
    """The cell of each token: its class, and depth - HALVINGS bits of its hash."""
    return (_class(tail) << (depth - HALVINGS)) | (h >> K.U64(64 - depth + HALVINGS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def told() -> pa.RecordBatch:
        h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cls, kind="stable")  # a token has one class, and small numbers are sorted faster than hashes with their places
        cuts = np.searchsorted(cls[order], np.arange(1, 1 << HALVINGS))
        own, n = zip(*(np.unique(x, return_counts=True) for x in np.split(h[order], cuts)), strict=True)
        cls = np.repeat(np.arange(1 << HALVINGS, dtype=np.int8), [len(x) for x in own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(cls), pa.array(np.concatenate(n).astype(np.int64))], ["h", "cls", "n"])

    for batch in batches:
        for _, _, part, off in K.blocks(*K.column(batch, "text")):
            h, tail, _ = tokens(part, off)
            held.append((h, _class(tail).astype(np.int8)))
            size += len(h)
            if size >= HELD:
                yield told()
                held, size = [], 0
    if held:
        yield told()


@dataclass
class Lexicon:
    """Exact counts: N and V; two direct-mapped tables of the most frequent tokens, the second for those whose place
    in the first is taken; the bits of a path, the unigram logit of each inner node, and each cell's mass (its log)."""

    total: int
    distinct: int
    keys: np.ndarray
    count: np.ndarray
    depth: int
    prior: np.ndarray
    mass: np.ndarray

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Counts; -1 for what is not in the tables."""
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for k in range(2):
            slot = _slot(h[rest], k)
            hit = self.keys[k][slot] == h[rest]
            out[rest[hit]] = self.count[k][slot[hit]]
            rest = rest[~hit]
        return out


def _slot(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> K.U64(k * 20)) & K.U64((1 << SLOT_BITS) - 1)).astype(np.int64)


def depth_of(distinct: int) -> int:
    """Bits of a path: so many levels that a cell has about 64 distinct tokens or fewer, within LEVELS."""
    wanted = math.ceil((math.log2(distinct + 1) - 6) / HALVINGS)
    return HALVINGS * min(LEVELS[1], max(LEVELS[0], wanted))


def rows_of(total: int) -> int:
    """The number of rows of weights, as a power of two."""
    return min(ROW_BITS[1], max(ROW_BITS[0], math.ceil(math.log2(total + 1)) - 5))


def rounds_of(total: int) -> int:
    return min(6, max(2, (total >> 23).bit_length()))


def unigram_tree(n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the inner nodes (number 1 is the root, 2k and 2k + 1 are the children of k) and logs of the cells' masses."""
    mass = n + 0.5 * (v + 1)
    prior, m = np.zeros(len(mass), np.float32), mass
    while len(m) > 1:
        left, right = m[0::2], m[1::2]
        prior[len(m) // 2 : len(m)] = np.log(right / left)
        m = left + right
    return prior, np.log(mass)


def lexicon(counts: DataFrame) -> Lexicon:
    """counts: h, cls, c of all training tokens."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    h, c = gathered(frequent(counts, "h", "c", TOP), "h", "c")  # at most TOP rows
    order = np.lexsort((h, -c))
    h, c = h[order].view(K.U64), c[order]
    keys, count = np.zeros((2, 1 << SLOT_BITS), K.U64), np.full((2, 1 << SLOT_BITS), -1, np.int64)
    for k in range(2):
        slot, first = np.unique(_slot(h, k), return_index=True)  # the most frequent token of a slot has it
        keys[k][slot], count[k][slot] = h[first], c[first]
        h, c = np.delete(h, first), np.delete(c, first)
    depth = depth_of(sums.v)
    cell = F.shiftleft(F.col("cls").cast("long"), depth - HALVINGS).bitwiseOR(F.shiftrightunsigned("h", 64 - depth + HALVINGS))
    where, n, v = gathered(counts.groupBy(cell.alias("cell")).agg(F.sum("c").alias("n"), F.count("*").alias("v")), "cell", "n", "v")  # at most 2**depth rows
    cell_n, cell_v = np.zeros(1 << depth), np.zeros(1 << depth)
    cell_n[where], cell_v[where] = n, v
    return Lexicon(int(sums.n), int(sums.v), keys, count, depth, *unigram_tree(cell_n, cell_v))


def histories(h: np.ndarray, tail: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A hash of each feature of each token's history."""
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(h), K.U64)
        b[k:] = h[:-k]
        b[place < k] = k
        back.append(b)
    one, two, three = back
    votes = np.zeros((len(h) + 1, 8), np.int32)
    np.cumsum(np.unpackbits((tail & K.U64(255)).astype(np.uint8)).reshape(-1, 8).astype(np.int32) * 2 - 1, axis=0, out=votes[1:])
    signs = np.packbits(votes[:-1] > votes[np.repeat(at[:-1], np.diff(at))], axis=1)[:, 0].astype(K.U64)
    return [one, K.mix(one * K.U64(3) + two), K.mix(two + K.U64(0x51ED)), K.mix(three + K.U64(0xA7B3)), K.mix(signs + K.U64(0xC001))]


_HALVING = np.arange(HALVINGS)[:, None]
#: For each class within a class (a column) and each halving (a row): the node in a row of weights, and whether the path goes right.
_NODE = (1 << _HALVING) | (np.arange(ROW) >> (HALVINGS - _HALVING))
_RIGHT = (np.arange(ROW) >> (HALVINGS - 1 - _HALVING)) & 1 == 1


def _levels(path: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level of classes: its number, the class so far, and for its halvings (a row each) the node in a row of weights,
    the node in the whole tree, and the side that the path takes."""
    for level in range(depth // HALVINGS):
        rest = depth - HALVINGS * (level + 1)
        prefix, code = path >> (rest + HALVINGS), (path >> rest) & (ROW - 1)
        node = _NODE.take(code, 1)
        tree = ((prefix + ((1 << HALVINGS * level) - 1)) << _HALVING) + node  # node has the bit of its halving, so one less stands before it
        yield level, prefix, node, tree, _RIGHT.take(code, 1)


def _weights_at(history: np.ndarray, feature: int, level: int, prefix: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    salt = (feature * 8 + level + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
    row = K.mix(history + (prefix.astype(K.U64) << K.U64(8)) * K.U64(0x9E3779B97F4A7C15) + K.U64(salt)) >> K.U64(64 - bits)
    return row.view(np.int64) * ROW + node


def fixed_point(w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights as whole numbers of 16 bits, and their unit: a table half as large stays in a processor's cache for longer.
    The unit is so large that the sum over the features of a level fits, too."""
    unit = float(np.abs(w).max()) * max(map(len, FEATURES)) / (1 << 15) * 1.001 or 1.0
    return np.rint(w / np.float32(unit)).astype(np.int16), unit


def log_probabilities(lex: Lexicon, w: np.ndarray, h: np.ndarray, tail: np.ndarray, at: np.ndarray, unit: float = 1.0) -> np.ndarray:
    """Natural logarithms of the probability of each token's cell after its history.  w: weights, in units."""
    prior, w, unit = lex.prior.view(np.float32), w.view(w.dtype.type), np.float32(unit)
    bits, seen, path = (len(w) // ROW).bit_length() - 1, histories(h, tail, at), paths(h, tail, lex.depth)
    out = np.zeros(len(h))
    for i in range(0, len(h), SCORED):
        s = slice(i, i + SCORED)
        for level, prefix, node, tree, right in _levels(path[s], lex.depth):
            first, *others = FEATURES[level]
            z = w.take(_weights_at(seen[first][s], first, level, prefix, node, bits))
            for f in others:
                z += w.take(_weights_at(seen[f][s], f, level, prefix, node, bits))
            z = prior.take(tree) + z * unit
            out[s] -= np.log((1 + np.exp(np.clip(np.where(right, -z, z), -30, 30))).prod(0, dtype=np.float64))
    return out


def learn(lex: Lexicon, w: np.ndarray, power: np.ndarray, h: np.ndarray, tail: np.ndarray, at: np.ndarray) -> None:
    """Gradient steps on some documents, in place; power has the sums of squares that set each weight's step size."""
    prior, w, power = (x.view(np.float32) for x in (lex.prior, w, power))  # numpy adds in place slowly where the type of an array came out of a pickle
    bits, seen, path = (len(w) // ROW).bit_length() - 1, histories(h, tail, at), paths(h, tail, lex.depth)
    for i in range(0, len(h), BATCH):
        s = slice(i, i + BATCH)
        for level, prefix, node, tree, right in _levels(path[s], lex.depth):
            z = prior.take(tree)
            where = [_weights_at(seen[f][s], f, level, prefix, node, bits) for f in FEATURES[level]]
            for x in where:
                z += w.take(x)
            g = np.exp(np.clip(np.negative(z, out=z), -30, 30, out=z), out=z)
            g = np.subtract(np.divide(1, np.add(g, 1, out=g), out=g), right, out=g).ravel()
            square, step = g * g, np.float32(RATE) * g
            for x in where:
                x = x.ravel()
                np.add.at(power, x, square)
                size = power.take(x)
                np.subtract.at(w, x, np.divide(step, np.sqrt(size, out=size), out=size))


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row of the chunks that this task has, over the tasks that changed it."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, value in zip(batch.column("chunk").to_pylist(), batch.column("value"), strict=True):
            x = np.frombuffer(value.as_py(), np.float16).astype(np.float32).reshape(CHUNK, ROW + 1)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
    for chunk, x in sums.items():
        mean = (x[:, :ROW] / np.maximum(x[:, ROW:], 1)).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([mean.tobytes()], pa.binary())], ["chunk", "value"])


def train(texts: DataFrame, lex: Lexicon) -> np.ndarray:
    """Weights after one pass over all texts (column text)."""
    sc = texts.sparkSession.sparkContext
    rows, rounds = 1 << rows_of(lex.total), rounds_of(lex.total)
    w = np.zeros(rows * ROW, np.float32)
    lexed = sc.broadcast(lex)  # 2**(SLOT_BITS + 1) slots and 2**depth cells
    texts = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(rounds)))
    tasks = max(1, -(-lex.total // (rounds * TASK_TOKENS)))
    for k in range(rounds):
        shared = sc.broadcast(w)  # at most 2**ROW_BITS[1] rows

        def changes(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lex, old = lexed.value, shared.value
            new, power = old.copy(), np.ones_like(old)
            for batch in batches:
                for _, _, part, off in K.blocks(*K.column(batch, "text")):
                    learn(lex, new, power, *tokens(part, off))
            del power
            for c in range(rows // CHUNK):
                at = slice(c * CHUNK * ROW, (c + 1) * CHUNK * ROW)
                diff = (new[at] - old[at]).reshape(CHUNK, ROW)
                changed = diff.any(1)
                if changed.any():
                    full = np.concatenate((diff, changed[:, None]), 1).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([full.tobytes()], pa.binary())], ["chunk", "value"])

        own = texts.where(F.col("part") == k).select("text").coalesce(tasks).mapInArrow(tidy(changes), "chunk long, value binary")
        for r in own.repartition(min(64, rows // CHUNK), "chunk").mapInArrow(tidy(_averaged), "chunk long, value binary").collect():  # the size of the weights
            w[r.chunk * CHUNK * ROW : (r.chunk + 1) * CHUNK * ROW] += np.frombuffer(r.value, np.float16)
        shared.destroy()
        give_back()
    lexed.unpersist()
    return w


def scored(documents: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of documents (doc_id long, text);
    training has the column text."""
    sc = documents.sparkSession.sparkContext
    documents = only(documents, "doc_id", "text")
    texts = training.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(tidy(_counts), "h long, cls byte, n long").groupBy("h").agg(F.max("cls").alias("cls"), F.sum("n").alias("c"))
    counts = saved(counts)
    lex = lexicon(counts)
    if not lex.total:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda x: x != "")).cast("long") + 1
        return documents.select("doc_id", n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    w = sc.broadcast(fixed_point(train(texts, lex)))
    give_back()
    lexed = sc.broadcast(lex)
    all_ = np.log(lex.total + 0.5 * (lex.distinct + 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with sums over the tokens in the tables (own), and one for each other distinct token."""
        lex, (small, unit) = lexed.value, w.value
        small = small.copy()  # numpy asks for large pages, a pickle does not
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
            for i, j, part, off in K.blocks(*K.column(batch, "text")):
                h, tail, at = tokens(part, off)
                c = lex.look_up(h)
                known = c >= 0
                log_c = np.log(np.maximum(c, 0) + 0.5)
                p = log_probabilities(lex, small, h, tail, at, unit) - lex.mass[paths(h, tail, lex.depth)] + np.where(known, log_c, 0.0)
                base = np.where(known, log_c - all_, 0.0)
                sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, p)]
                own = keys[i:j]
                salt = K.mix(own.view(K.U64) + K.U64(77)).view(np.int64)
                doc, other = np.repeat(np.arange(j - i), np.diff(at))[~known], h[~known]
                order = np.lexsort((other, doc))
                doc, other = doc[order], other[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])))) if len(doc) else np.zeros(0, np.int64)
                m, k = np.diff(np.append(first, len(doc))), len(first)
                whole = np.arange(j - i + k) < j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((own, own[doc[first]]))),
                        pa.array(np.concatenate((salt, other[first].view(np.int64)))),
                        pa.array(whole),
                        pa.array(np.concatenate((np.zeros(j - i, np.int32), m.astype(np.int32)))),
                        pa.concat_arrays([ids.slice(i, j - i), pa.nulls(k, ids.type)]),
                        *(pa.array(np.concatenate((x, np.zeros(k, x.dtype))), mask=~whole) for x in (np.diff(at), *sums)),
                    ],
                    ["key", "h", "own", "n", "doc_id", "n_tokens", "known", "base", "p"],
                )

    kinds = "key long, h long, own boolean, n int, doc_id long, n_tokens long, known long, base double, p double"
    rows = documents.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(tidy(partial), kinds)
    rows = rows.join(counts.select("h", "c"), "h", "left")
    other, log_c = ~F.col("own"), F.log(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = rows.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.count_if("own").alias("copies"),
        (F.sum("known") + F.sum(F.when(other & F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("known"),
        (F.sum("base") + F.sum(F.when(other, F.col("n") * (log_c - F.lit(float(all_)))).otherwise(0.0))).alias("base"),
        (F.sum("p") + F.sum(F.when(other, F.col("n") * log_c).otherwise(0.0))).alias("p"),
    )
    ten = F.lit(float(np.log(10.0)))
    out = sums.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies") / ten).alias("base_score"), (F.col("p") / F.col("copies") / ten).alias("score"))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from rows whose crc32(doc_id) mod 5 is not 1."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 1
    out = scored(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
