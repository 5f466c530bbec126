"""Retrieval inside an analysis: requests that ask the same are looked up once, and find what each would by itself."""

from __future__ import annotations

import glob
import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from cinderlog.operators import chunk, retrieve, vector_index
from cinderlog.plans import pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder


class Counted(chunk.HashedEncoder):
    """Leaves a line in a file for each text."""

    def __init__(self, folder):
        super().__init__(64)
        self.path = f"{folder}/{os.getpid()}-{uuid.uuid4().hex}"

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(x + "\n" for x in texts))
        return super().__call__(texts)


def test_teams_of_another_type_are_found(spark):
    """Rows' teams are int, queries' are long; each team has a row that each of its queries finds."""
    corpus = spark.range(60).select(F.col("id").alias("failure_id"), F.col("id").cast("int").alias("team_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    q = spark.range(120).select(F.col("id").alias("query_id"), (F.col("id") % 60).alias("team_id"), F.array(F.lit(1.0), F.lit(0.4)).alias("vector"), F.lit(None).cast("string").alias("same"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would come to lie in one task
    try:
        found = vector_index.search(vector_index.build(corpus), q, 0.5, 3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found)) == [(i, i % 60) for i in range(120)]


def test_rows_that_a_join_drops_are_not_encoded(spark, tmp_path):
    """A filter on vectors stays above the join that leaves 3 of 500 rows."""
    rows = spark.range(500).select("id", F.concat(F.lit("error "), "id").alias("t")).join(spark.range(3), "id")
    assert chunk.embed(rows, "t", encoder=lambda: Counted(str(tmp_path))).where(F.size("embedding") > 0).count() == 3
    assert sorted(x for path in glob.glob(f"{tmp_path}/*") for x in open(path)) == ["error 0\n", "error 1\n", "error 2\n"]


def test_the_same_question_is_encoded_once(spark, tmp_path):
    """300 requests of two teams with five texts, in projects with chunks of their own, without, and in none: as by single searches."""
    texts = ["connection refused by the db", "heap out of memory", "x509 expired", "no space left on device", ""]
    words = [*texts[:4], "connection refused", "heap of memory", "x509 is expired", "space left on the device"]
    encode = chunk.HashedEncoder(64)
    asks = [(i, i % 2, None if i % 7 == 6 else i % 7, ["DATABASE", None][i % 3 == 0], texts[i % 5], None, "unit") for i in range(300)]
    requests = spark.createDataFrame(asks, "request_id long, team_id long, project_id long, category string, error_message string, ecosystem string, job_name string").repartition(5)
    documents = spark.createDataFrame([(d, f"doc {d}", [None, 0, 1, 2][d % 4], d != 5) for d in range(16)], "id long, title string, project_id long, is_active boolean")
    parts = [(d, i, d % 2, f"{words[(d + i) % 8]} {d}", [float(x) for x in encode([words[(d + i) % 8]])[0]]) for d in range(16) for i in range(3)]
    chunks = spark.createDataFrame(parts, "document_id long, chunk_index int, team_id int, content string, embedding array<float>")
    failures = [(i, i % 2, ["DATABASE", None, "TEST"][i % 3], f"p{i}", [float(x) for x in encode([f"{words[i % 8]} | category: DATABASE | job: unit"])[0]], f"fix {i}" if i % 4 else None) for i in range(40)]
    corpus = spark.createDataFrame(failures, "failure_id long, team_id long, category string, project_name string, embedding array<float>, known_resolution string")
    corpus = corpus.withColumns({"error_message": F.lit("e"), "failed_at": F.lit("2024-01-05").cast("timestamp"), "resolved_at": F.when(F.col("failure_id") % 2 == 0, F.lit("2024-01-06").cast("timestamp")), "resolution_note": F.lit("note")})
    found = {r.request_id: r for r in pipeline.retrieved(requests, pipeline.Sources(corpus, chunks, documents, lambda: Counted(str(tmp_path)))).collect()}
    assert sorted(found) == list(range(300))
    encoded = [x for path in glob.glob(f"{tmp_path}/*") for x in open(path)]
    assert len(encoded) == 2 * len({(t, c, e) for _, t, _, c, e, _, _ in asks}) == 40
    singles, some = {}, 0
    for i, team, project, category, error, _, job in asks[:14]:
        if (team, project, category, error) not in singles:
            like = " | ".join(x for x in (error, f"category: {category}" if category else None, f"job: {job}") if x is not None)
            about = " ".join(x for x in (category, error) if x is not None)
            near, known = ([float(x) for x in encode([text])[0]] for text in (like, about))
            similar = [(r.similarity, r.project_name, r.resolution) for r in retrieve.similar_failures(corpus, near, team, category).collect()]
            seeds = retrieve.knowledge(chunks, documents, known, team, project, 3).withColumns({"query_id": F.lit(1), "rank": F.monotonically_increasing_id()}).collect() if any(known) else []
            seeds = spark.createDataFrame([(1, n, r.document_id, r.chunk_index, r.similarity) for n, r in enumerate(seeds)], "query_id long, rank int, document_id long, chunk_index int, similarity double")
            singles[team, project, category, error] = similar, [(r.title, r.content, r.similarity) for r in retrieve.expand_neighbours(seeds, chunks, documents).orderBy("position").collect()]
        similar, knowledge = singles[team, project, category, error]
        assert [tuple(x) for x in found[i].similar or []] == similar
        assert [tuple(x) for x in found[i].knowledge or []] == knowledge
        some += bool(similar) + 2 * bool(knowledge)
    assert some > 14
