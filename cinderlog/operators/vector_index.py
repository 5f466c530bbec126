"""Exact cosine search over a table of vectors by spherical cells.

Centres are fitted on a bounded sample; every vector lies in the cell of its nearest centre and keeps its
angle to it. For each team and cell the smallest and the largest of these angles are kept. The angle between
two unit vectors obeys the triangle inequality, so a query whose angle to a centre is `b` can be within an
angle `t` of a vector of that cell only if some angle `a` of the cell has |a - b| <= t: all other cells are left
out, whatever the sample was. Queries and rows then meet by (team, cell) in tiles of bounded size, so a team
that holds most rows is split over many tasks; a tile is one matrix product, and hands on each query's
best rows only. Similarities of what is left are calculated anew, in the order of the coordinates.

Vectors that are null, of another length than the centres, or zero have no cosine and are never found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.workers import materialised, workers_find_package

#: Rows that centres are fitted on at most, and how many centres there are.
SAMPLE, CELLS, STEPS = 4096, 64, 8
#: Rows and queries of a tile, about.
TILE_ROWS, TILE_QUERIES = 8192, 1024
#: Angles and similarities in a tile are off by far less.
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def fitted(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by spherical k-means, begun with vectors far from each other."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    for _ in range(min(cells, len(vectors)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(STEPS):
        own = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors, and which of them have a cosine."""
    lists = column.to_pylist()
    good = np.array([x is not None and len(x) == dims and None not in x for x in lists], bool)
    out = np.zeros((len(lists), dims))
    if good.any():
        out[good] = np.array([x for x, g in zip(lists, good, strict=True) if g], np.float64)
    length = np.linalg.norm(out, axis=1)
    return unit(out), good & (length > 0) & np.isfinite(length)


def _angles(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1.0, 1.0))


@dataclass(frozen=True)
class VectorIndex:
    """rows: the corpus with `cell`, and `angle` to its centre; cells: team, cell, low, high, n; centres: unit vectors."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    key: str
    team: str
    vector: str

    def write(self, path: str) -> None:
        """The index as tables: rows by cell, cells, and centres with the columns' names."""
        spark = self.rows.sparkSession
        self.rows.repartition("cell", F.pmod(F.xxhash64(self.key), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        self.cells.write.parquet(f"{path}/cells")
        centres = [(i, c.tolist(), self.key, self.team, self.vector) for i, c in enumerate(self.centres)]
        spark.createDataFrame(centres, "cell int, centre array<double>, key string, team string, vector string").coalesce(1).write.parquet(f"{path}/centres")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    centres = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)  # CELLS rows
    first = centres[0]
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), np.array([r.centre for r in centres]), first.key, first.team, first.vector)


def build(corpus: DataFrame, key: str = "failure_id", team: str = "team_id", vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """The index of every row of a corpus; centres are fitted on the `sample` rows with the smallest hash of their key."""
    some = corpus.where(F.size(vector) > 0).select(vector, F.xxhash64(key).alias("h")).orderBy("h", vector).limit(sample)
    vectors = [r[0] for r in some.collect() if None not in r[0]]
    dims = max({len(x) for x in vectors}, key=[len(x) for x in vectors].count, default=1)
    vectors = np.array([x for x in vectors if len(x) == dims], np.float64).reshape(-1, dims)
    vectors = unit(vectors[np.linalg.norm(vectors, axis=1) > 0])
    centres = fitted(vectors, cells) if len(vectors) else np.eye(1, dims)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def place(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x, good = _matrix(part, dims)
            near = x @ centres.T
            cell = near.argmax(1)
            angle = _angles(near[np.arange(len(x)), cell])
            yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32), mask=~good), pa.array(angle)], ["cell", "angle"])

    workers_find_package(corpus.sparkSession)
    rows = corpus.withColumn("__place", place(F.col(vector))).select("*", F.col("__place.cell").alias("cell"), F.col("__place.angle").alias("angle")).drop("__place")
    rows = materialised(rows.where("cell IS NOT NULL"))
    stats = materialised(rows.groupBy(team, "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")))
    return VectorIndex(rows, stats, centres, key, team, vector)


def _looks(index: VectorIndex, queries: DataFrame, threshold: float) -> DataFrame:
    """query_id, team, cell, n of the cells in which a query may find a row."""
    centres, dims = index.centres, index.centres.shape[1]

    @F.arrow_udf("array<double>")
    def angles(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x, good = _matrix(part, dims)
            yield pa.array([a.tolist() if g else None for a, g in zip(_angles(x @ centres.T), good, strict=True)], pa.list_(pa.float64()))

    workers_find_package(queries.sparkSession)
    far = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    asked = queries.select("query_id", F.col("team_id").alias(index.team), F.posexplode(angles(F.col("vector"))).alias("cell", "b"))
    near = (F.col("b") - F.col("high") <= far) & (F.col("low") - F.col("b") <= far)
    return asked.join(index.cells, [index.team, "cell"]).where(near).select("query_id", index.team, "cell", "n")


def candidates(index: VectorIndex, queries: DataFrame, threshold: float) -> DataFrame:
    """query_id, cells, candidate_rows, team_rows: what a search looks through, and what it would look through without cells."""
    whole = index.cells.groupBy(F.col(index.team).alias("team_id")).agg(F.sum("n").alias("team_rows"))
    seen = _looks(index, queries, threshold).groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("candidate_rows"))
    rows = queries.select("query_id", "team_id").join(whole, "team_id", "left").join(seen, "query_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select("query_id", F.coalesce("cells", zero).alias("cells"), F.coalesce("candidate_rows", zero).alias("candidate_rows"), F.coalesce("team_rows", zero).alias("team_rows"))


def search(index: VectorIndex, queries: DataFrame, threshold: float, k: int, prefer: Column | None = None, same: Column | None = None, only_same: bool = False, keys: list[str] | None = None) -> DataFrame:
    """query_id and the keys of rows among which each query's k best are, by (prefer, same, similarity).

    queries: query_id, team_id, vector, and `same`. prefer: a condition on rows that come first. same: a column of
    rows held against the queries' column `same`: null on either side comes first, then equal ones; only_same leaves
    out rows where both are set and differ. Rows within a tiny difference of a query's k-th best are kept too, so that
    a caller who calculates similarities exactly finds the same k as by looking through all rows.
    """
    keys = keys or [index.key]
    team = index.team
    looks = materialised(_looks(index, queries, threshold))
    tiles = looks.groupBy(team, "cell", "n").agg(F.count("*").alias("asked"))
    tiles = materialised(tiles.select(team, "cell", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("a"), F.ceil(F.col("asked") / TILE_QUERIES).cast("int").alias("b")))
    number = lambda of, parts: F.pmod(F.xxhash64(*of), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = index.rows.select(team, "cell", *keys, F.col(index.vector).alias("v"), F.coalesce(prefer, F.lit(False)).cast("int").alias("first") if prefer is not None else F.lit(0).alias("first"), (same if same is not None else F.lit(None)).cast("string").alias("same"))
    # a cogroup doesn't make its keys' types alike, as a join does: both sides take the tiles' own
    theirs = tiles.withColumnsRenamed({team: "__team", "cell": "__cell"})
    own = own.join(theirs, (F.col(team) == F.col("__team")) & (F.col("cell") == F.col("__cell")))
    own = own.select(F.col("__team").alias(team), F.col("__cell").alias("cell"), *own.drop(team, "cell", *theirs.columns).columns, number(keys, "a").alias("i"), every("b").alias("j"))
    asked = queries.select("query_id", F.col("vector").alias("qv"), F.col("same").cast("string").alias("qsame"))
    placed = looks.join(tiles, [team, "cell"]).select("query_id", F.col(team).alias(team), F.col("cell").alias("cell"), number(["query_id"], "b").alias("j"), every("a").alias("i"))
    asked = placed.join(asked, "query_id")
    dims = index.centres.shape[1]
    schema = [f for f in asked.select("query_id").schema.fields] + [f for f in own.select(*keys).schema.fields]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        q, _ = _matrix(left.column("qv").combine_chunks(), dims)
        x, _ = _matrix(right.column("v").combine_chunks(), dims)
        first, ours, theirs = right.column("first").to_numpy(), np.array(right.column("same").to_pylist(), object), left.column("qsame").to_pylist()
        unset = np.array([y is None for y in ours], bool)
        at, found = [], []
        for begin in range(0, len(q), 64):
            near = q[begin : begin + 64] @ x.T
            for i, s in enumerate(near, begin):
                equal = ours == theirs[i] if theirs[i] is not None else np.zeros(len(x), bool)
                open_ = unset | (theirs[i] is None)
                good = np.flatnonzero((s >= threshold - SLACK) & (open_ | equal | (not only_same)))
                rank = 4.0 * (3 * first[good] + np.where(open_[good], 2, np.where(equal[good], 1, 0))) + s[good]
                if len(good) > k:
                    good = good[rank >= np.partition(rank, len(rank) - k)[len(rank) - k] - SLACK]
                at.append(np.full(len(good), i))
                found.append(good)
        at, found = (np.concatenate(y) if y else np.empty(0, np.int64) for y in (at, found))
        return pa.table({"query_id": left.column("query_id").take(pa.array(at, pa.int64()))} | {name: right.column(name).take(pa.array(found, pa.int64())) for name in keys})

    by = [team, "cell", "i", "j"]
    from pyspark.sql.types import StructType

    return asked.groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(tile, StructType(schema))
