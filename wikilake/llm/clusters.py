"""Clusters of vectors about centroids, by Yinyang's group bounds, in whole numbers.

The centroids are put into groups once.  A vector carries an upper bound of the distance to its centroid and one lower bound
for each group, of the distance to every other centroid of it; after an update the bounds give way by how far centroids
have moved.  A vector whose upper bound stays below all lower bounds keeps its centroid (the global filter); else
only groups whose lower bound doesn't exceed it are looked at (the group filter), and of these all centroids, by exact squared distances
in integers.  Bounds are widened by more than their rounding errors, and equal distances pass no filter, so the
result is that of comparing all pairs.  A round is one pass over the vectors, without a shuffle of them: each task gives its vectors with
their bounds, and sums of each centroid's vectors, which Spark adds up.

Kept are vectors with exactly `width` components, none null, NaN or infinite.  A component x becomes floor(scale * x); beyond
+-2**27 it counts as that, since squared distances would not fit a long.  The first centroids are the kept vectors with the
smallest hashes of their vec_id; with fewer vectors there are fewer centroids.  Rows that share a vec_id are vectors of their own, ordered by their
components where they tie; those without one are clustered like others but begin no cluster unless too few have one.  Equal vectors are
each told.  An empty table gives no rows; sums of distances beyond a long are null.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikilake.llm.common import saved, table, tidy

WIDTH, SCALE, CLUSTERS, UPDATES = 64, 256, 40, 5
#: Centroids of a group, about; passes that form the groups.
GROUP, GROUP_PASSES = 10, 5
LIMIT = 1 << 27
#: Components up to this give exact products in doubles: 64 * (2**22)**2 < 2**53.
EXACT = 1 << 21
#: Bounds are widened by this share, well above the rounding of a square root and five sums.
SLACK = 1e-9
#: Vectors of a block of comparisons.
ROWS = 8_192
STATE = "vec_id long, v binary, cluster int, distance long, upper double, lower binary, n long, sums array<long>"


class Model(NamedTuple):
    """centroids: k x width whole numbers; groups: the numbers of each group's centroids, rising."""

    centroids: np.ndarray
    groups: list[np.ndarray]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v from all of c."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1) if len(c) else np.empty((len(v), 0), np.int64)


def grouped(centroids: np.ndarray) -> list[np.ndarray]:
    """The centroids in groups of about GROUP: a few passes of nearest means, from centroids spread over their order."""
    k = len(centroids)
    t = max(1, k // GROUP)
    means = centroids[np.arange(t) * k // t].astype(np.float64)
    for _ in range(GROUP_PASSES):
        near = ((centroids[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([centroids[near == g].mean(0) if (near == g).any() else means[g] for g in range(t)])
    return [x for g in range(t) if len(x := np.flatnonzero(near == g))]


def assigned(v: np.ndarray, model: Model, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each vector to its nearest centroid, from bounds that hold (an upper of infinity: unknown), and tightens them.
    Returns how many distances of vectors from others' centroids were taken."""
    looked = 0
    open_ = np.flatnonzero(lower.min(1) <= upper)
    known = open_[np.isfinite(upper[open_])]
    if len(known):  # the global filter again, with the distance itself
        upper[known] = np.sqrt(((v[known] - model.centroids[cluster[known]]) ** 2).sum(1)) * (1 + SLACK)
        open_ = open_[lower[open_].min(1) <= upper[open_]]
    if not len(open_):
        return looked
    x, was = v[open_], cluster[open_].copy()
    far = np.iinfo(np.int64).max
    first = ~np.isfinite(upper[open_])
    own = np.where(first, far, ((x - model.centroids[was]) ** 2).sum(1))
    best, at = own.copy(), np.where(first, far, was)
    old_upper, scanned = upper[open_].copy(), []
    for g, members in enumerate(model.groups):
        rows = np.flatnonzero(lower[open_, g] <= old_upper)
        if not len(rows):
            continue
        d = squared(x[rows], model.centroids[members])
        looked += d.size
        near = d.argmin(1)  # the smallest number of equals
        least, name = d[np.arange(len(rows)), near], members[near]
        d[np.arange(len(rows)), near] = far
        scanned.append((g, rows, least, name, d.min(1)))
        wins = (least < best[rows]) | ((least == best[rows]) & (name < at[rows]))
        best[rows[wins]], at[rows[wins]] = least[wins], name[wins]
    group_of = np.empty(len(model.centroids), np.int64)
    for g, members in enumerate(model.groups):
        group_of[members] = g
    # a centroid given up bounds its group, if that has not been scanned
    left = np.flatnonzero(~first & (at != was))
    g = group_of[was[left]]
    lower[open_[left], g] = np.minimum(lower[open_[left], g], np.sqrt(own[left]) * (1 - SLACK))
    for g, rows, least, name, second in scanned:
        others = np.where(name == at[rows], second, least)
        lower[open_[rows], g] = np.where(others == far, np.inf, np.sqrt(others.astype(np.float64)) * (1 - SLACK))
    cluster[open_], upper[open_] = at, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return looked


def _round(df: DataFrame, model: Model, before: np.ndarray | None) -> DataFrame:
    """A pass: rows of vectors with their centroid, distance and bounds, and rows of sums by centroid (v is null).
    before: the centroids of the pass before, whose bounds the rows carry; None: they carry none."""
    moved = None if before is None else np.sqrt(((model.centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
    drift = None if moved is None else np.array([moved[g].max() for g in model.groups])
    k, width, t = *model.centroids.shape, len(model.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                m = batch.num_rows
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(m, width).astype(np.int64)
                if moved is None:
                    cluster, upper, lower = np.zeros(m, np.int64), np.full(m, np.inf), np.zeros((m, t))
                else:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    upper = batch.column("upper").to_numpy() * (1 + SLACK) + moved[cluster]
                    lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float64).reshape(m, t) * (1 - SLACK) - drift
                assigned(v, model, cluster, upper, lower)
                order, sizes = np.argsort(cluster, kind="stable"), np.bincount(cluster, minlength=k)
                full = np.flatnonzero(sizes)
                n += sizes
                sums[full] += np.add.reduceat(v[order], (np.cumsum(sizes) - sizes)[full]) if m else 0
                distance = ((v - model.centroids[cluster]) ** 2).sum(1)
                packed = pa.array([row.tobytes() for row in lower], pa.binary())
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(upper), packed, none, pa.nulls(m, pa.list_(pa.int64()))], STATE_NAMES)
        full = np.flatnonzero(n)
        none = [pa.nulls(len(full), kind) for kind in (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none[:2], pa.array(full, pa.int32()), *none[2:], pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], STATE_NAMES)

    return df.mapInArrow(tidy(run), STATE)


STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def kept(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), e * scale))))).cast("int"))
    return vectors.select("vec_id", "embedding").where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _packed(df: DataFrame) -> DataFrame:
    """v as the bytes of its numbers; nothing else is sent in the rounds."""

    def run(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().astype("<i4")
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    return df.mapInArrow(tidy(run), "vec_id long, v binary")


def fit(vectors: DataFrame, clusters: int = CLUSTERS, updates: int = UPDATES, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the kept vectors after the updates, saved, and the centroids.  The driver holds
    clusters x width numbers, and a few sums of as many."""
    whole = kept(vectors, width, scale)
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()  # at most `clusters` rows
    state = _packed(whole)
    if not first:
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.empty((0, width), np.int64)
    centroids = np.array([r.v for r in first], np.int64)
    groups, before = grouped(centroids), None
    for turn in range(updates + 1):
        state = saved(_round(state, Model(centroids, groups), before))
        if turn == updates:
            break
        every = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        sums = state.where("v is null").groupBy("cluster").agg(F.sum("n").alias("n"), *every).collect()  # at most `clusters` rows
        state = state.where("v is not null").drop("n", "sums")
        before, centroids = centroids, centroids.copy()
        for r in sums:
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return state.where("v is not null").select("vec_id", "cluster", "distance"), centroids


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    found, centroids = fit(vectors, **options)
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")
    by = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(exact).collect()}  # a row a cluster
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(d), fits(sum(by.values())), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in by.items()]
    stats = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of embeddings that is kept."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(clusters: int = CLUSTERS, updates: int = UPDATES, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same by comparing all pairs, a round a step."""
    good = f"len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {good})",
        "parts AS MATERIALIZED (SELECT row, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept QUALIFY cluster < {clusters})",
    ]
    for k in range(updates + 1):
        distance = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT row, vec_id, min(struct_pack(d := d, cluster := cluster)) AS best FROM (SELECT row, vec_id, cluster, CAST({distance} AS BIGINT) AS d FROM kept, c{k}) GROUP BY row, vec_id)")
        if k < updates:
            mean = "SELECT best.cluster AS cluster, i, sum(x) AS s, count(*) AS n FROM a{0} JOIN parts USING (row) GROUP BY best.cluster, i".format(k)
            floor = "CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list({floor} ORDER BY i) AS c FROM ({mean}) GROUP BY cluster) m USING (cluster))")
    joined = "array_to_string(c, ',')"
    out = f"SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256({joined}) AS centroid_sha256 FROM a{updates} JOIN c{updates} ON best.cluster = c{updates}.cluster"
    return f"WITH {', '.join(steps)} {out}"


SQL = _sql()
