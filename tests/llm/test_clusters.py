"""Clusters against all pairs in numpy, and the bounds against their purpose: fewer distances, the same result."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikilake.llm import clusters


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int, n int")


def brute(rows, k, updates, width, scale=256):
    """Whole numbers in Python, all pairs, ties to the smaller number."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            kept.append((i, [int(max(-clusters.LIMIT, min(clusters.LIMIT, np.floor(float(np.float32(x)) * scale)))) for x in v]))
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1])) + sorted((x for x in kept if x[0] is None), key=lambda x: x[1])
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(updates):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, j in found:
        by[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, by[j], sum(by.values()), digest[j]) for i, d, j in found)


def odd_rows(rng, width):
    rows = [(k, rng.normal(0, 1, width).tolist()) for k in range(260)]
    rows += [(300 + k, (np.round(rng.normal(0, 1, width) * 2) / 2).tolist()) for k in range(120)]  # many ties
    rows += [(500 + k, rows[3][1]) for k in range(150)]  # a hot vector
    rows += [(7, rows[8][1]), (7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(800, None), (801, []), (802, [1.0] * (width - 1)), (803, [None] + [1.0] * (width - 1)), (804, [float("nan")] + [1.0] * (width - 1)), (805, [float("-inf")] + [0.0] * (width - 1))]
    return rows


@pytest.mark.parametrize(("width", "k", "big"), [(64, 40, False), (3, 40, False), (5, 12, True), (2, 1, False)])
def test_clusters_equal_all_pairs(spark, width, k, big):
    rng = np.random.default_rng(width)
    rows = odd_rows(rng, width)
    if big:
        rows += [(900 + j, (rng.normal(0, 1, width) * 10.0 ** (3 + j)).tolist()) for j in range(30)]
    df = frame(spark, rows).repartition(5)
    got = Counter(map(tuple, clusters.clustered(df, clusters=k, updates=4, width=width).collect()))
    assert got == brute(rows, k, 4, width)


def test_few_and_no_vectors(spark):
    rows = [(k, [float(k), 0.5]) for k in range(3)] + [(9, [0.0, 0.5])]
    got = clusters.clustered(frame(spark, rows), clusters=40, updates=5, width=2)
    assert Counter(map(tuple, got.collect())) == brute(rows, 40, 5, 2)
    for none in ([], [(1, None), (2, [1.0])]):
        empty = clusters.clustered(frame(spark, none), width=2)
        assert empty.columns == got.columns and empty.count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-200, 200, (40, 64))
    v = (middles[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))).astype(np.int64)
    model = clusters.Model(v[:40].copy(), clusters.grouped(v[:40]))
    assert sorted(np.concatenate(model.groups)) == list(range(40)) and len(model.groups) > 1
    t = len(model.groups)
    cluster, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, t))
    assert clusters.assigned(v, model, cluster, upper, lower) == 4000 * 40
    looked = []
    for _ in range(5):
        d = clusters.squared(v, model.centroids)
        assert (cluster == d.argmin(1)).all()
        near = np.where(np.arange(40)[None] == cluster[:, None], np.iinfo(np.int64).max, d)
        for g, members in enumerate(model.groups):  # each bound holds
            assert (lower[:, g] <= np.sqrt(near[:, members].min(1))).all()
        new = np.stack([v[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else model.centroids[c] for c in range(40)])
        moved = np.sqrt(((new - model.centroids) ** 2).sum(1)) * (1 + clusters.SLACK)
        upper = upper * (1 + clusters.SLACK) + moved[cluster]
        lower = lower * (1 - clusters.SLACK) - np.array([moved[g].max() for g in model.groups])
        model = clusters.Model(new, model.groups)
        looked.append(clusters.assigned(v, model, cluster, upper, lower))
    assert (cluster == clusters.squared(v, model.centroids).argmin(1)).all()
    assert looked[-1] < 0.5 * 4000 * 40


def test_query_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, v) for i, v in odd_rows(np.random.default_rng(2), 64) if i is not None and i != 7]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = clusters.op13_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(clusters.SQL).fetchall())
    assert dict(got.select(F.col("cluster"), F.col("distance"), F.col("inertia")).dtypes) == {"cluster": "int", "distance": "bigint", "inertia": "bigint"}
