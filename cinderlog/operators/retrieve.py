"""Retrieval: similar failures, signature history, knowledge chunks and their neighbours.

A single query vector is a literal and its top rows come from TakeOrderedAndProject. A
batch of queries goes through an index of spherical cells (vector_index): queries and rows
meet by team and cell, in tiles of bounded size, and only each query's best rows leave one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions import regex
from cinderlog.functions.vector import as_sent, cosine
from cinderlog.operators import vector_index
from cinderlog.operators.vector_index import VectorIndex
from cinderlog.settings import DEFAULTS, Settings
from cinderlog.workers import materialised

_LOG = logging.getLogger(__name__)


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(round(float(x), 6)) for x in values))


def failure_corpus(embeddings: DataFrame, failures: DataFrame, projects: DataFrame, signatures: DataFrame) -> DataFrame:
    """Failures with vector, project and signature; Spark broadcasts what is small enough."""
    s = signatures.select(F.col("id").alias("signature_id"), F.col("known_resolution"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return embeddings.select("failure_id", "team_id", "embedding").join(failures.withColumnRenamed("id", "failure_id"), "failure_id").join(p, "project_id").join(s, "signature_id", "left")


def similar_failures(corpus: DataFrame, vector: list[float], team_id: int, category: str | None = None, exclude: int | None = None, limit: int | None = None, threshold: float | None = None, null_order: str = "as_written", settings: Settings = DEFAULTS) -> DataFrame:
    """The team's failures most like a vector: resolved ones first, then those of the category, then by distance.

    null_order: where a failure's category is null, "as_written" puts it first, "documented" last.
    """
    category = None if category == "UNKNOWN" else category or None
    rows = corpus.where(F.col("team_id") == team_id)
    if exclude is not None:
        rows = rows.where(F.col("failure_id") != exclude)
    rows = rows.withColumn("__s", cosine(F.col("embedding"), vector_literal(vector))).where(F.col("__s") >= (settings.similarity_threshold if threshold is None else threshold))
    same = F.lit(None).cast("boolean") if category is None else F.col("category") == category
    order = same.desc_nulls_first() if null_order == "as_written" else same.desc_nulls_last()
    return _shaped(rows.orderBy(F.col("resolved_at").isNotNull().desc(), order, F.col("__s").desc(), "failure_id").limit(limit or settings.max_similar_failures))


def _shaped(rows: DataFrame) -> DataFrame:
    extra = [c for c in ("query_id", "rank") if c in rows.columns]
    return rows.select(
        *extra, "failure_id", "project_name", "category", "error_message", F.round("__s", 4).alias("similarity"),
        F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), F.coalesce(regex.nonempty(F.col("known_resolution")), F.col("resolution_note")).alias("resolution"), F.col("resolved_at").isNotNull().alias("resolved"),
    )


def similar_batch(corpus: DataFrame | VectorIndex, queries: DataFrame, limit: int | None = None, threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """similar_failures for every row of queries (query_id, team_id, vector, category, exclude_id).

    corpus: an index over failures, or failures of which one is made.
    """
    k, least = limit or settings.max_similar_failures, settings.similarity_threshold if threshold is None else threshold
    index = corpus if isinstance(corpus, VectorIndex) else vector_index.build(corpus)
    q = materialised(queries.select("query_id", "team_id", as_sent(F.col("vector")).alias("vector"), F.when(F.col("category") != "UNKNOWN", regex.nonempty(F.col("category"))).alias("same"), "exclude_id"))
    # one more than asked for, as the row to leave out may be among them
    near = vector_index.search(index, q, least, k + 1, F.col("resolved_at").isNotNull(), F.col("category"))
    asked = q.select("query_id", F.col("vector").alias("__v"), F.col("same").alias("__c"), "exclude_id")
    scored = near.join(index.rows.drop("cell", "angle"), "failure_id").join(asked, "query_id").where(F.col("exclude_id").isNull() | (F.col("failure_id") != F.col("exclude_id")))
    scored = scored.withColumn("__s", cosine(F.col("embedding"), F.col("__v"))).where(F.col("__s") >= least)
    order = [F.col("resolved_at").isNotNull().desc(), (F.col("category") == F.col("__c")).desc_nulls_first(), F.col("__s").desc(), F.col("failure_id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return _shaped(ranked.where(F.col("rank") <= k))


def signature_history(requests: DataFrame, signatures: DataFrame) -> DataFrame:
    """requests with the history of (team_id, signature_hash), is_known only with a resolution that has text."""
    known = F.coalesce(F.col("is_known"), F.lit(False)) & regex.nonempty(F.col("known_resolution")).isNotNull()
    history = signatures.dropDuplicates(["team_id", "hash"]).select(
        "team_id", F.col("hash").alias("signature_hash"), F.struct("hash", "category", "subcategory", "occurrence_count", known.alias("is_known"), "known_root_cause", "known_resolution").alias("history")
    )
    return requests.join(history, ["team_id", "signature_hash"], "left")


def knowledge(chunks: DataFrame, documents: DataFrame, vector: list[float], team_id: int, project_id: int | None = None, limit: int = 4, threshold: float | None = None, null_order: str = "as_written", settings: Settings = DEFAULTS) -> DataFrame:
    """The team's active chunks most like a vector, of the project or of no project."""
    docs = documents.where("is_active").select(F.col("id").alias("document_id"), "title", "project_id")
    if project_id is not None:
        docs = docs.where(F.col("project_id").isNull() | (F.col("project_id") == project_id))
    rows = chunks.where(F.col("team_id") == team_id).join(docs, "document_id").withColumn("__s", cosine(F.col("embedding"), vector_literal(vector)))
    own = F.lit(None).cast("boolean") if project_id is None else F.col("project_id") == project_id
    order = own.desc_nulls_first() if null_order == "as_written" else own.desc_nulls_last()
    rows = rows.where(F.col("__s") >= (settings.knowledge_threshold if threshold is None else threshold))
    return rows.orderBy(order, F.col("__s").desc(), "document_id", "chunk_index").limit(limit).select("document_id", "chunk_index", "title", "content", F.round("__s", 4).alias("similarity"))


def knowledge_index(chunks: DataFrame, documents: DataFrame) -> VectorIndex:
    """An index over the chunks of active documents, with title and the document's project."""
    docs = documents.where("is_active").select(F.col("id").alias("document_id"), "title", F.col("project_id").alias("__project"))
    rows = chunks.select("document_id", "chunk_index", "team_id", "content", "embedding").join(docs, "document_id")
    return vector_index.build(rows, key="document_id")


def own_projects(index: VectorIndex) -> DataFrame:
    """team_id, project_id of the projects with chunks of their own in an index as knowledge_index makes it."""
    return index.rows.where("__project IS NOT NULL").select(F.col(index.team).alias("team_id"), F.col("__project").alias("project_id")).distinct()


def knowledge_batch(chunks: DataFrame | VectorIndex, documents: DataFrame | None, queries: DataFrame, limit: int | None = None, threshold: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """knowledge for every row of queries (query_id, team_id, project_id, vector), with its rank; chunks: or an index as knowledge_index makes it."""
    k, least = limit or settings.max_knowledge_seeds, settings.knowledge_threshold if threshold is None else threshold
    index = chunks if isinstance(chunks, VectorIndex) else knowledge_index(chunks, documents)
    q = materialised(queries.select("query_id", "team_id", as_sent(F.col("vector")).alias("vector"), F.col("project_id").alias("same")))
    near = vector_index.search(index, q, least, k, None, F.col("__project"), only_same=True, keys=["document_id", "chunk_index"])
    asked = q.select("query_id", F.col("vector").alias("__v"), F.col("same").alias("__p"))
    rows = near.join(index.rows.drop("cell", "angle"), ["document_id", "chunk_index"]).join(asked, "query_id")
    rows = rows.withColumn("__s", cosine(F.col("embedding"), F.col("__v"))).where(F.col("__s") >= least)
    order = [(F.col("__project") == F.col("__p")).desc_nulls_first(), F.col("__s").desc(), F.col("document_id"), F.col("chunk_index")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "document_id", "chunk_index", "title", "content", F.round("__s", 4).alias("similarity"))


def lookup_pairs(chunks: DataFrame, documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks named by (document_id, chunk_index) whose document is active."""
    found = chunks.join(pairs.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_semi")
    return found.join(documents.where("is_active").select(F.col("id").alias("document_id"), "title"), "document_id").select("document_id", "chunk_index", "title", "content")


def expand_neighbours(seeds: DataFrame, chunks: DataFrame, documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each seed chunk with those around it: query_id, position, document_id, chunk_index, title, content, similarity.

    seeds: query_id, rank, document_id, chunk_index, similarity. Documents come in the order
    of their first seed; a document's chunks carry the similarity of its last seed.
    """
    r = settings.neighbour_radius
    around = F.explode(F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda d: F.col("chunk_index") + d)).alias("chunk_index")
    wanted = seeds.select("query_id", "document_id", around).where("chunk_index >= 0").distinct()
    per_document = seeds.groupBy("query_id", "document_id").agg(F.min("rank").alias("__rank"), F.max_by("similarity", "rank").alias("similarity"))
    titles = documents.where("is_active").select(F.col("id").alias("document_id"), "title")
    found = chunks.select("document_id", "chunk_index", "content").join(wanted, ["document_id", "chunk_index"]).join(titles, "document_id").join(per_document, ["query_id", "document_id"])
    placed = found.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("__rank", "chunk_index")))
    return placed.where(F.col("position") <= settings.max_knowledge_chunks).select("query_id", "position", "document_id", "chunk_index", "title", "content", "similarity")


def safely(build: Callable[[], DataFrame], empty: DataFrame) -> tuple[DataFrame, bool]:
    """A retrieval's rows, or `empty` and False if Spark can't plan or run it: a failed lookup never fails an analysis.

    Errors of this library's own code aren't caught.
    """
    try:
        found = build()
        found.schema  # analysis errors show here
    except (PySparkException, Py4JJavaError) as e:
        _LOG.warning("retrieval failed, analyses go on without it: %s", type(e).__name__)
        return empty, False
    return found, True
