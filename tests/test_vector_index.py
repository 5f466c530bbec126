from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.operators import retrieve, vector_index
from cinderlog.plans import queries, views

SF = "/root/testdata/sf0.01"


def made(rng, n, dims=12, groups=9):
    """Vectors around a few directions, with repeats, a zero one, a null one and one of another length."""
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))
    x[n // 2] = x[0]
    rows = [[float(np.float32(y)) for y in v] for v in x]
    rows[3], rows[4], rows[5] = [0.0] * dims, None, [1.0]
    return rows


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else None


@pytest.mark.parametrize("threshold", [-1.0, 0.1, 0.55, 0.9])
@pytest.mark.parametrize("k", [1, 5])
def test_search_equals_brute_force(spark, monkeypatch, threshold, k):
    """One team has nine tenths of the rows, so its cells are split into tiles."""
    monkeypatch.setattr(vector_index, "TILE_ROWS", 40)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = made(rng, 400)
    rows = [(i, 0 if i % 10 else 1, v, i % 3 == 0, [None, "a", "b"][i % 4 % 3]) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "failure_id long, team_id long, embedding array<float>, good boolean, category string").repartition(3)
    asked = [(i, i % 3, [round(float(y), 6) for y in (vectors[i * 7 % 400] or [0.5] * 12)], [None, "a", "b"][i % 3]) for i in range(60)]
    q = spark.createDataFrame(asked, "query_id long, team_id long, vector array<double>, same string")
    index = vector_index.build(corpus, cells=8)
    found = {}
    for r in vector_index.search(index, q, threshold, k, F.col("good"), F.col("category")).collect():
        found.setdefault(r.query_id, set()).add(r.failure_id)
    for i, team, v, same in asked:
        scored = []
        for j, t, x, good, category in rows:
            s = cosine(x, v)
            if t == team and s is not None and s >= threshold:
                scored.append((not good, 0 if category is None or same is None else 1 if category == same else 2, -s, j))
        scored.sort()
        best = {x[3] for x in scored[:k]}
        assert best <= found.get(i, set())
        assert len(found.get(i, set())) <= 60 * k  # a tile hands on its best rows only
    counts = {r.query_id: r for r in vector_index.candidates(index, q, threshold).collect()}
    assert len(counts) == 60 and all(r.candidate_rows <= r.team_rows for r in counts.values())
    if threshold == 0.9:
        assert sum(r.candidate_rows for r in counts.values()) < 0.4 * sum(r.team_rows for r in counts.values())


def test_written_index_finds_the_same(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, v) for i, v in enumerate(made(rng, 90))]
    corpus = spark.createDataFrame(rows, "failure_id long, team_id long, embedding array<float>")
    q = spark.createDataFrame([(i, i % 2, rows[i * 2 + 10][2], None) for i in range(9)], "query_id long, team_id long, vector array<double>, same string")
    index = vector_index.build(corpus, cells=5)
    index.write(str(tmp_path / "index"))
    again = vector_index.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, vector_index.search(index, q, 0.5, 3).collect())) == sorted(map(tuple, vector_index.search(again, q, 0.5, 3).collect()))


def test_no_rows(spark):
    none = spark.createDataFrame([], "failure_id long, team_id long, embedding array<float>")
    q = spark.createDataFrame([(1, 1, [1.0], None)], "query_id long, team_id long, vector array<double>, same string")
    assert vector_index.search(vector_index.build(none), q, 0.5, 3).count() == 0
    assert vector_index.candidates(vector_index.build(none), q, 0.5).first().candidate_rows == 0


def test_a_batch_equals_single_searches(spark):
    """Both kinds of retrieval, over the test tables: each query by itself and all together."""
    corpus = queries._corpus(spark, SF).cache()
    some = [r.failure_id for r in corpus.select("failure_id").orderBy("failure_id").limit(200).collect()][::40]
    rows = {r.failure_id: r for r in corpus.where(F.col("failure_id").isin(some)).collect()}
    q = spark.createDataFrame([(i, r.team_id, [float(x) for x in r.embedding], r.category, i) for i, r in rows.items()], "query_id long, team_id long, vector array<double>, category string, exclude_id long")
    batch = retrieve.similar_batch(corpus, q, threshold=0.05)
    names = [c for c in batch.columns if c not in ("query_id", "rank")]
    got = {}
    for r in batch.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append([r[c] for c in names])
    for i, r in rows.items():
        one = retrieve.similar_failures(corpus, [float(x) for x in r.embedding], r.team_id, r.category, i, threshold=0.05)
        assert [[x[c] for c in names] for x in one.collect()] == got.get(i, [])
    v = lambda sql: views.view(spark, SF, sql)
    chunks, documents = v(views.KNOWLEDGE_CHUNKS), v(views.KNOWLEDGE_DOCUMENTS)
    kq = spark.createDataFrame([(i, r.team_id, i % 7 if i % 2 else None, [float(x) for x in r.embedding]) for i, r in rows.items()], "query_id long, team_id long, project_id long, vector array<double>")
    batch = retrieve.knowledge_batch(chunks, documents, kq, limit=4, threshold=0.05)
    got = {}
    for r in batch.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.document_id, r.chunk_index, r.title, r.content, r.similarity))
    for i, r in rows.items():
        one = retrieve.knowledge(chunks, documents, [float(x) for x in r.embedding], r.team_id, i % 7 if i % 2 else None, 4, threshold=0.05)
        assert [tuple(x) for x in one.collect()] == got.get(i, [])
