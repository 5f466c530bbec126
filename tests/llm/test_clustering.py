from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from cinderlog.llm import clustering

DIR = "/root/testdata/sf0.001"


def brute(vectors, k, rounds, seed="2:", scale=256):
    """(cluster, distance) of each (vec_id, vector), and the centroids, in Python's integers."""
    v = [tuple(int(np.floor(scale * float(x))) for x in vec) for _, vec in vectors]
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"{seed}{vectors[i][0]}".encode()).hexdigest(), v[i]))
    centroids = [v[i] for i in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for x in v]
        for c in range(len(centroids)):
            mine = [x for x, o in zip(v, own, strict=True) if o == c]
            if mine:
                centroids[c] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    return [nearest(x) for x in v], centroids


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check(spark, rows, k, rounds, dims, scale=256):
    found = clustering.cluster(table(spark, rows).repartition(3), k=k, rounds=rounds, dims=dims, scale=scale).collect()
    want, centroids = brute(rows, k, rounds, scale=scale)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {c: sum(d for d, o in want if o == c) for _, c in want}
    expected = sorted((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(rows, want, strict=True))
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == expected


def test_ties_and_repeats_equal_brute_force(spark):
    """Small integers make ties common; half of the rows repeat another's vector, some its id too."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 4) / 256).tolist()) for i in range(120)]
    rows += [(i + 200, rows[i][1]) for i in range(60)] + [(7, rows[7][1]), (7, rows[8][1])]
    check(spark, rows, 9, 5, 4)


def test_groups_of_distant_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 40 * rng.integers(0, 5)).astype(np.float32).tolist()) for i in range(200)]
    check(spark, rows, 12, 6, 8)


def test_large_components_keep_exact_distances(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.rint(rng.uniform(-6e7, 6e7, 4)).astype(np.float32).tolist()) for i in range(50)]
    check(spark, rows, 5, 3, 4, scale=1)


def test_bounds_skip_distances_and_stay_true():
    rng = np.random.default_rng(8)
    v = np.rint(rng.normal(size=(2000, 16)) * 20 + 300 * rng.integers(0, 10, (2000, 1))).astype(np.int32)
    before = v[:20].astype(np.int64)
    cluster, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf, np.float32), np.zeros((2000, 20), np.float32)
    clustering.assign(v, before, cluster, upper, lower)
    after = before + rng.integers(-2, 3, before.shape)
    clustering.move(before, after, cluster, upper, lower)
    exact = np.sqrt(((v[:, None, :].astype(np.int64) - after) ** 2).sum(2).astype(np.longdouble))
    assert (lower <= exact).all() and (upper >= exact[np.arange(2000), cluster]).all()
    calculated = clustering.assign(v, after, cluster, upper, lower)
    assert calculated < 0.25 * v.shape[0] * 20
    assert (cluster == (exact**2).argmin(1)).all()


def test_odd_vectors_are_left_out(spark):
    good = [(1, [0.5, 0.25]), (2, [-0.5, 0.0]), (None, [0.1, 0.1]), (3, [0.5, 0.25])]
    odd = [(4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])]
    found = clustering.cluster(table(spark, good + odd).selectExpr("*", "'x' AS cluster", "1 AS v", "2 AS upper"), k=40, dims=2).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert len({r.cluster for r in found if r.vec_id in (1, 3)}) == 1 and sum(r.distance for r in found) == 0
    assert clustering.cluster(table(spark, odd), dims=2).count() == 0
    assert clustering.cluster(table(spark, []), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="don't fit a long"):
        clustering.cluster(table(spark, [(1, [1e30, 0.0])]), dims=2).count()


def test_the_test_table_equals_sql(spark):
    found = clustering.cluster(spark.read.parquet(f"{DIR}/embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.sql(clustering.duck_sql()).df()
    assert sorted(map(tuple, found.collect())) == sorted(tuple(x) for x in want[found.columns].itertuples(index=False))
