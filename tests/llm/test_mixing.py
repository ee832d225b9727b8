"""The mix against a second implementation: streams, draws, permutations and what each document gives, row by row."""

import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest
import xxhash
from pyspark.sql import functions as F

from wikilake.llm import mixing

B, SHARD = 8, 16


def h64(*values):
    """Spark's xxhash64 of longs (int: 4 bytes, by its own rule, are not used here), texts and nulls."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def water(sizes, weights, total):
    """Targets by turns, as the contract words it."""
    goal = [Fraction(w * total) / sum(weights) for w in weights]
    for _ in sizes:
        over = [g > 2 * n for g, n in zip(goal, sizes)]
        spare = sum(g - 2 * n for g, n, o in zip(goal, sizes, over) if o)
        goal = [2 * n if o else g for g, n, o in zip(goal, sizes, over)]
        free = [w if g < 2 * n else 0 for w, g, n in zip(weights, goal, sizes)]
        if not spare or not sum(free):
            break
        goal = [g + spare * f / sum(free) for g, f in zip(goal, free)]
    return goal


def frame(spark, docs):
    rows = [(*r, "x", "x", 1, "x", "x", 5) for r in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, s string, size int, block string, hash string, slot int")


def sample():
    docs = []
    for k in range(120):
        docs.append((k, " ".join(f"w{k}x{j}" for j in range((k * 37) % 61)), ["hot", "b", "ü", "", None, "rare"][0 if k % 3 else k // 3 % 6]))
    docs += [(500, "one\ttwo three \n", "tiny"), (501, None, "none"), (None, "no id here", "b"), (7, "again seven", "b"), docs[5], docs[5], (502, " ".join(["long"] * 900), "b"), (None, None, None)]
    return docs


def test_mix_equals_brute_force(spark):
    docs = sample()
    mixed = mixing.mix(frame(spark, docs), block=B, shard=SHARD)
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(words(t)) for _, t, s in docs if s == name) for name in names]
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    goal = water(sizes, weights, Fraction(3, 2) * sum(sizes))
    got = {r.s: r for r in mixed.sources.collect()}
    assert [got[k].source_size for k in range(len(names))] == sizes
    assert all(got[k].target == float(goal[k]) for k in range(len(names)))
    # streams
    streams = {}
    for k, name in enumerate(names):
        own = sorted((h64(i, t), i if i is not None else -1, len(words(t)), words(t)) for i, t, s in docs if s == name)
        streams[k] = [(i, w, text) for _, i, n, text in own for w in text]
    slots = mixed.slots.orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(sum(got[k].slots for k in got))) and all(r.shard == r.slot // SHARD for r in slots)
    # each source takes its target, whole epochs first, and no block beyond it
    for k in range(len(names)):
        mine = [r for r in slots if r.s == k]
        assert sum(r.length for r in mine) == floor(goal[k] + Fraction(1, 2)) == got[k].words
        n, full = ceil(sizes[k] / B), sizes[k] // B
        by_epoch = defaultdict(list)
        for r in mine:
            by_epoch[r.epoch].append(r.block)
        for e, blocks in by_epoch.items():
            assert len(set(blocks)) == len(blocks) and (e == max(by_epoch) or sorted(blocks) == list(range(n)))
        assert all(r.length == min(B, sizes[k] - r.block * B) for r in sorted(mine, key=lambda r: r.length)[1:] if r.block < full)
    # the draws themselves: a slot keeps what it drew unless its source has enough
    edges, total = [], sum(got[k].slots for k in got)
    for k in range(len(names)):
        edges += [k] * got[k].slots
    had, wrong = Counter(), 0
    for r in slots:
        drew = edges[h64_after_int(mixing.SEED, r.slot) % total]
        wrong += r.s != drew and had[drew] < got[drew].slots
        had[drew] += 1
    assert not wrong
    # texts
    want = Counter()
    for r in slots:
        want[(r.slot, names[r.s], " ".join(w for _, w, _ in streams[r.s][r.block * B : r.block * B + r.length]))] += 1
    assert Counter((r.slot, r.source, r.text) for r in mixing.texts(frame(spark, docs), mixed).collect()) == want
    # what each document gives
    give = Counter()
    for r in slots:
        for p in range(r.block * B, r.block * B + r.length):
            give[(r.s, p)] += 1
    want = Counter()
    for k, name in enumerate(names):
        at = 0
        while at < len(streams[k]):
            i, _, text = streams[k][at]
            want[(None if i == -1 else i, len(text), sizes[k], sum(give[(k, p)] for p in range(at, at + len(text))))] += 1
            at += len(text)
        want += Counter((i, 0, sizes[k], 0) for i, t, s in docs if s == name and not words(t))
    rows = mixing.taken(frame(spark, docs), block=B, shard=SHARD).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in rows) == want
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(frame(spark, docs).repartition(7), block=B, shard=SHARD).collect()))


def h64_after_int(first, value):
    """xxhash64 of an int column, then of a long one."""
    mask = (1 << 64) - 1
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (42 + p5 + 4) & mask
    h ^= (first & 0xFFFFFFFF) * p1 & mask
    h = (((h << 23) | (h >> 41)) & mask) * p2 + p3 & mask
    h = (h ^ (h >> 33)) * p2 & mask
    h = (h ^ (h >> 29)) * p3 & mask
    h ^= h >> 32
    out = xxhash.xxh64_intdigest(struct.pack("<q", value), h)
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 24, 48, 49, 50, 1000, 4999])
def test_permutations_are_whole(spark, n):
    got = [r.y for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("y")).collect()]
    assert sorted(got) == list(range(n)) and (n < 24 or got != sorted(got))


def test_odd_tables(spark):
    assert mixing.taken(frame(spark, [])).collect() == []
    rows = mixing.taken(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = " ".join(map(str, range(200_000)))
    rows = {r.doc_id: r for r in mixing.taken(frame(spark, [(1, long, "a"), (2, "x", "b"), (3, "x", "b")])).collect()}
    assert rows[1].taken == 300_003 - 4 and rows[2].taken == rows[3].taken == 2  # b is at its limit, a takes the rest
