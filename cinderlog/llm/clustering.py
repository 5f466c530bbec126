"""Centroid clustering with Elkan's bounds, on integer vectors.

Vectors become integers floor(scale * x). Each round assigns every vector to its nearest centroid
(squared Euclidean distance, ties to the smaller number) and replaces each centroid by the
exact floor of its vectors' mean; empty ones stay.

With its vector every row carries an upper bound of the distance to its own centroid and a lower
bound of the distance to each other one. When centroids move, bounds are moved by as much;
a distance is calculated only where neither the bounds nor half the distance between
two centroids rule it out. Upper bounds are rounded up and lower ones down, and a
centroid is ruled out only where it must be strictly farther, so ties are never lost.
Distances are calculated in integers, as are the final ones of all vectors.

Vectors are never shuffled: a round is a pass over the rows where they lie, written to the shared
folder with its bounds, and then a pass that adds up the vectors of each cluster, of which a
task hands on one row a cluster. The driver holds the k centroids.

Cases: vectors of another length, or with a null or non-finite component, are left out, and so
is a null vector; with fewer than k vectors there are as many centroids; a null vec_id's vector
is clustered but starts a centroid only after all others; of vectors that repeat a vec_id the smaller
(component by component) starts first, and repeated rows are all returned; an empty table gives an empty
result; components of 2**26 and more after scaling are an error, as squared distances would not fit a long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, map_arrow

LARGEST = 1 << 26
#: A calculated distance is off by far less than this share of itself.
SLACK = 1e-6


def _up(x: np.ndarray) -> np.ndarray:
    """Distances made a little larger, as 32-bit floats."""
    return (np.asarray(x, np.float64) * (1 + SLACK)).astype(np.float32)


def _down(x: np.ndarray) -> np.ndarray:
    """Distances made a little smaller and cut to the upper 16 bits of 32-bit floats, 0 at least."""
    small = np.maximum(np.asarray(x, np.float64) * (1 - SLACK), 0).astype(np.float32)
    return (small.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v and c."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down; infinite to itself."""
    d = centroids[:, None, :].astype(np.int64) - centroids[None, :, :]
    out = _down(np.sqrt((d * d).sum(2)) / 2)
    np.fill_diagonal(out, np.inf)
    return out


def assign(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Updates cluster, upper and lower of the vectors v; returns how many distances it calculated.

    On entry the bounds hold for these centroids.
    """
    half = half_gaps(centroids)
    nearest = half.min(1) if len(centroids) > 1 else np.array([np.inf])
    open_ = np.flatnonzero(~(upper < nearest[cluster]))
    best = np.zeros(len(v), np.int64)
    best[open_] = squared(v[open_], centroids[cluster[open_]])
    upper[open_] = _up(np.sqrt(best[open_]))
    lower[open_, cluster[open_]] = _down(np.sqrt(best[open_]))
    calculated = len(open_)
    open_ = open_[~(upper[open_] < nearest[cluster[open_]])]
    for c in range(len(centroids)):
        now, u = cluster[open_], upper[open_]
        at = open_[(now != c) & ~(u < lower[open_, c]) & ~(u < half[now, c])]
        if len(at):
            calculated += len(at)
            d = squared(v[at], centroids[c])
            lower[at, c] = _down(np.sqrt(d))
            better = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
            at, d = at[better], d[better]
            cluster[at], best[at], upper[at] = c, d, _up(np.sqrt(d))
    return calculated


def move(before: np.ndarray, after: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """Bounds after the centroids have moved."""
    far = _up(np.sqrt(squared(before, after)))
    upper[:] = _up(upper.astype(np.float64) + far[cluster])
    lower[:] = _down(lower.astype(np.float64) - far)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _list(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    data = np.ascontiguousarray(values)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the integer components, of the vectors that are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            column = batch.column("x")
            column = column.filter(length := pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
            ids, x = batch.column("vec_id").filter(length), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(1)  # a null component is read as no number
            x = np.floor(scale * x[good])
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"vec_id {ids.filter(pa.array(good))[int((np.abs(x) >= LARGEST).any(1).argmax())]}: squared distances of a component of 2**26 after scaling don't fit a long")
            yield {"vec_id": ids.filter(pa.array(good)), "v": _list(x.astype(np.int32))}

    return map_arrow(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")), run, "vec_id long, v array<int>")


def _first(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of seed and vec_id."""
    rows = kept.select("v", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r.v for r in rows.collect()], np.int64)


def _step(state: DataFrame, before: np.ndarray | None, after: np.ndarray) -> DataFrame:
    """State with every vector assigned to its nearest centroid of `after`; before: those of the state's bounds, None at first."""
    k, dims = after.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            v = _vectors(batch.column("v"), dims)
            if before is None:
                cluster, upper, lower = np.zeros(len(v), np.int32), np.full(len(v), np.inf, np.float32), np.zeros((len(v), k), np.float32)
            else:
                cluster, upper = batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy().copy()
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<u2").astype(np.uint32) << np.uint32(16)
                lower = lower.view(np.float32).reshape(-1, k)
                move(before, after, cluster, upper, lower)
            assign(v, after, cluster, upper, lower)
            yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": cluster, "upper": upper, "lower": _binary((lower.view(np.uint32) >> np.uint32(16)).astype("<u2"))}

    return cut(map_arrow(state, run, "vec_id long, v array<int>, cluster int, upper float, lower binary"))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the clusters' means; empty clusters keep their centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster = _vectors(batch.column("v"), dims).astype(np.int64), batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(v[order], first)
            n += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(n)
        yield {"cluster": own.astype(np.int32), "n": n[own], "s": _list(sums[own])}

    parts = map_arrow(state.select("v", "cluster"), run, "cluster int, n long, s array<long>")
    total = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(x for x in total)).alias("s")).collect():  # k rows at most
        out[r.cluster] = [int(x) // r.n for x in r.s]
    return out


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    spark = table.sparkSession
    state = cut(whole_vectors(table, id_col, vector_col, dims, scale))
    centroids = _first(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    before = None
    for _ in range(rounds):
        state = _step(state, before, centroids)
        before, centroids = centroids, _means(state, centroids)
    state = _step(state, before, centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = batch.column("cluster")
            yield {"vec_id": batch.column("vec_id"), "cluster": own, "distance": squared(_vectors(batch.column("v"), dims), centroids[own.to_numpy()])}

    found = cut(map_arrow(state.select("vec_id", "v", "cluster"), final, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in centroids]
    clusters = spark.createDataFrame([(c, d, digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")  # k rows


def duck_sql(k: int = 40, rounds: int = 5, seed: str = "2:", dims: int = 64, scale: int = 256) -> str:
    """DuckDB SQL of cluster(), a pair of common table expressions for each round."""
    parts = [
        f"""whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"kept AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, v) - 1 AS i, vec_id, v FROM whole)",
        f"c0 AS (SELECT i AS c, v FROM kept WHERE i < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS (SELECT x.i, min({{'d': CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': y.c}}) AS m
            FROM kept x, c{r} y GROUP BY x.i)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (SELECT m.c AS c, p, sum(v[p]) AS s, count(*) AS n FROM a{r} JOIN kept USING (i), range(1, {dims + 1}) t(p) GROUP BY ALL),
            n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{r} GROUP BY c),
            c{r + 1} AS (SELECT o.c, coalesce(n{r}.v, o.v) AS v FROM c{r} o LEFT JOIN n{r} USING (c))"""
            )
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (i) JOIN c{rounds} y ON y.c = m.c"""
