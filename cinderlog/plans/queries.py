"""The library's own queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.functions.numbers import rounded_sql
from cinderlog.functions.vector import cosine, shannon_entropy
from cinderlog.operators import analyze, chunk, classify, extract, ledger, providers, recommend, redact, retrieve, signature
from cinderlog.plans import duck, pipeline, views
from cinderlog.sources.versioned import VersionedTable
from cinderlog.workers import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs, dealt by log_id over more tasks than there are cores: a log takes far longer than its event, and a file of
    events may be one row group, so one task."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return spark.sql(views.CI_LOGS, events=events.repartition(max(32, 4 * spark.sparkContext.defaultParallelism), "event_id"))


def _cte(build: Callable[[], tuple[str, str]], select: str, more: str = "") -> str:
    ctes, last = build()
    return f"WITH {ctes}{more} {select.replace('{last}', last)}"


# -- logs -------------------------------------------------------------------------


@query(_cte(duck.cleaned, "SELECT log_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS cleaned_sha256 FROM {last}"))
def clean_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract.clean(logs(spark, sf_dir), "raw_log")
    return df.select("log_id", F.length("cleaned").cast("long").alias("n_chars"), F.sha2("cleaned", 256).alias("cleaned_sha256"))


_EXCERPT = """array_to_string(CASE WHEN fam IS NULL THEN lines[greatest(1, len(lines) - 119) : len(lines)] ELSE lines[greatest(first - 15, 0) + 1 : least(len(lines), hits[-1] + 16)] END, chr(10))"""


@query(_cte(duck.extracted, f"""SELECT log_id, fam AS ecosystem, msg AS error_message, CAST(len(hits) AS BIGINT) AS n_hits, CAST(CASE WHEN fam IS NULL THEN greatest(len(lines) - 120, 0) ELSE greatest(first - 15, 0) END + 1 AS BIGINT) AS start_line,
    array_to_string(list_transform(hits[1:50], lambda x: CAST(x + 1 AS VARCHAR)), ',') AS matched_lines, sha256({_EXCERPT}) AS excerpt_sha256, CASE WHEN fam IS NOT NULL THEN sha256(blk) END AS block_sha256 FROM {{last}}"""))
def extract_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract.extract(extract.clean(logs(spark, sf_dir), "raw_log"))
    e = F.col("extraction")
    return df.select(
        "log_id", e["ecosystem"].alias("ecosystem"), e["error_message"].alias("error_message"), F.size(e["matched_lines"]).cast("long").alias("n_hits"), e["excerpt_start_line"].cast("long").alias("start_line"),
        F.array_join(F.transform(e["matched_lines"], lambda x: x.cast("string")), ",").alias("matched_lines"), F.sha2(e["excerpt"], 256).alias("excerpt_sha256"), F.sha2(e["error_block"], 256).alias("block_sha256"),
    )


@query(_cte(duck.cleaned, f"SELECT log_id, CAST(regexp_extract_all(t, {duck.pattern(rules.EXIT_CODE, 'i')}, 1)[-1] AS INTEGER) AS exit_code FROM {{last}}"))
def exit_code_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.clean(logs(spark, sf_dir), "raw_log").select("log_id", extract.exit_code(F.col("cleaned")).alias("exit_code"))


@query(_cte(duck.extracted, "SELECT coalesce(fam, 'none') AS ecosystem, count(*) AS n FROM {last} GROUP BY 1"))
def error_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract.families(extract.clean(logs(spark, sf_dir), "raw_log"))
    return df.groupBy(F.coalesce("family", F.lit("none")).alias("ecosystem")).agg(F.count("*").alias("n"))


@query(_cte(duck.extracted, "SELECT log_id, substr(coalesce(list_filter(useful, lambda x: length(x) > 10)[-1], useful[-1]), 1, 500) AS message FROM {last}"))
def last_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract.clean(logs(spark, sf_dir), "raw_log")
    return df.select("log_id", extract.last_meaningful(F.split("cleaned", "\n", -1)).alias("message"))


@query(_cte(duck.extracted, f"SELECT log_id, CAST(length(raw_log) AS BIGINT) AS original_chars, CAST(length({_EXCERPT}) AS BIGINT) AS excerpt_chars, {rounded_sql(f'1 - CAST(length({_EXCERPT}) AS DOUBLE) / greatest(length(raw_log), 1)', 4)} AS ratio FROM {{last}}"))
def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extract.extract(extract.clean(logs(spark, sf_dir), "raw_log"))
    a, b = F.length("raw_log"), F.length("extraction.excerpt")
    return df.select("log_id", a.cast("long").alias("original_chars"), b.cast("long").alias("excerpt_chars"), extract.reduction_ratio(a, b).alias("ratio"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    families, runs = extract.prefilter(), signature.prefilter()
    found = Prefilter([*families.sets, *runs.sets])
    df = extract.clean(logs(spark, sf_dir), "raw_log").withColumn("bits", found.column(F.col("cleaned")))
    gates = found.gates(F.col("bits"))
    df = extract.extract(df, gates=gates[: len(families.sets)])
    e = F.col("extraction")
    df = df.withColumn("basis", signature.basis(e["error_block"], e["error_message"], F.col("cleaned")))
    df = signature.normalise(df, "basis", gates=gates[len(families.sets) :])
    return df.withColumn("signature_hash", signature.signature_hash(e["ecosystem"], F.col("normalised")))


@query(_cte(duck.signed, "SELECT log_id, norm AS normalised, signature_hash FROM {last}"))
def signature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("log_id", "normalised", "signature_hash")


_ROLLUP = "SELECT team_id, signature_hash, count(*) AS occurrence_count, count(DISTINCT project_id) AS projects_affected, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM {last} GROUP BY 1, 2"


@query(_cte(duck.signed, _ROLLUP))
def signature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature.rollup(_signed(spark, sf_dir))


@query(_cte(duck.signed, "SELECT occurrence_count, count(*) AS signatures FROM (SELECT team_id, signature_hash, count(*) AS occurrence_count FROM {last} GROUP BY 1, 2) q GROUP BY 1"))
def signature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature.histogram(signature.rollup(_signed(spark, sf_dir)))


def _scored_sql(select: str) -> str:
    return f"WITH {duck.scored('(' + views.plain(views.CI_LOGS) + ') q', 'raw_log')} {select}"


@query(_scored_sql("SELECT log_id, x.category AS category, x.subcategory AS subcategory, round(x.score, 6) AS score FROM (SELECT log_id, unnest(found) AS x FROM sc) q"))
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.hits(logs(spark, sf_dir), "raw_log", "h").select("log_id", F.explode_outer("h").alias("x")).where("x IS NOT NULL")
    return df.select("log_id", "x.category", "x.subcategory", F.round("x.score", 6).alias("score"))


@query(_scored_sql("SELECT log_id, x.category AS category, round(x.score, 6) AS score FROM (SELECT log_id, unnest(scores) AS x FROM sc) q"))
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify.hits(logs(spark, sf_dir), "raw_log", "h").select("log_id", F.explode_outer(regex.let(F.col("h"), classify.category_scores)).alias("x")).where("x IS NOT NULL")
    return df.select("log_id", "x.category", F.round("x.score", 6).alias("score"))


@query(_scored_sql("SELECT log_id, category, subcategory, confidence, matched_rules FROM cl"))
def classify_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("classification")
    return classify.classify_rules(logs(spark, sf_dir), "raw_log").select("log_id", c["category"].alias("category"), c["subcategory"].alias("subcategory"), c["confidence"].alias("confidence"), F.array_join(c["matched_rules"], ",").alias("matched_rules"))


@query(_scored_sql("SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(matched_rules, ',')) AS rule FROM cl WHERE matched_rules <> '') q GROUP BY 1"))
def matched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.matched_rules(logs(spark, sf_dir), "raw_log").select(F.explode_outer("matched_rules").alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), '{c.category}', '{c.subcategory}', CAST({c.weight} AS DOUBLE))" for i, c in enumerate(rules.CAUSES)) + ") t(idx, category, subcategory, weight)")
def classifier_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classifier_catalog(spark)


@query()
def process_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every log through all stages, counted by signature."""
    df = pipeline.process_logs(logs(spark, sf_dir))
    return df.groupBy("signature_hash", F.col("extraction.ecosystem").alias("ecosystem"), F.col("classification.category").alias("category")).agg(F.count("*").alias("n"), F.min("log_id").alias("first_log"))


# -- redaction --------------------------------------------------------------------

_ALL = [x.name for x in rules.REDACTIONS]
_PLAIN = [x for x in _ALL if x != "aws_secret"]  # that one needs lookaround


def _redact_sql(names: list[str], source: str = "(SELECT doc_id, text FROM documents) q", column: str = "text", key: str = "doc_id") -> str:
    ctes, last = duck.redacted(source, column, names)
    order = sorted(names)
    kinds = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN k_{x} > 0 THEN '{x}' END" for x in order) + "], lambda x: x IS NOT NULL), ',')"
    return f"WITH {ctes} SELECT {key}, CAST({' + '.join(f'k_{x}' for x in names)} AS BIGINT) AS n, {kinds} AS types, sha256(t) AS text_sha256 FROM {last}"


def _redacted(df: DataFrame, column: str, key: str, names: list[str], strict: bool = False) -> DataFrame:
    chosen = [x for x in rules.REDACTIONS if x.name in names]
    r = F.col("redaction")
    return redact.redact(df, column, strict=strict, chain=chosen).select(key, r["count"].cast("long").alias("n"), F.array_join(r["types"], ",").alias("types"), F.sha2(r["text"], 256).alias("text_sha256"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(_redact_sql(["email"]))
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(_documents(spark, sf_dir), "text", "doc_id", ["email"])


@query(_redact_sql(["env_secret"]))
def redact_env_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(_documents(spark, sf_dir), "text", "doc_id", ["env_secret"])


_TOKENS = [x for x in _PLAIN if x not in ("email", "env_secret")]


@query(_redact_sql(_TOKENS))
def redact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(_documents(spark, sf_dir), "text", "doc_id", _TOKENS)


@query(_redact_sql(_PLAIN))
def redaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(_documents(spark, sf_dir), "text", "doc_id", _PLAIN)


@query(_redact_sql(_PLAIN, f"({views.plain(views.CI_LOGS)}) q", "raw_log", "log_id"))
def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(logs(spark, sf_dir), "raw_log", "log_id", _PLAIN)


@query()
def redact_aws_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(table(spark, sf_dir, "documents"), "text", "doc_id", ["aws_secret"])


@query()
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(table(spark, sf_dir, "documents"), "text", "doc_id", _ALL, strict=True)


@query("""SELECT item_id, round(coalesce(-list_sum(list_transform(list_distinct(string_split(text, '')), lambda c: (len(list_filter(string_split(text, ''), lambda d: d = c)) / CAST(length(text) AS DOUBLE)) * log2(len(list_filter(string_split(text, ''), lambda d: d = c)) / CAST(length(text) AS DOUBLE)))), 0), 6) AS entropy FROM benchmark""")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(shannon_entropy(F.col("text")), 6).alias("entropy"))


# -- retrieval --------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda sql: views.view(spark, sf_dir, sql)
    return retrieve.failure_corpus(v(views.FAILURE_EMBEDDINGS), v(views.FAILURES), v(views.PROJECTS), v(views.SIGNATURES))


_CORPUS = f"""corpus AS (SELECT fe.failure_id, fe.team_id, fe.embedding, f.category, f.error_message, f.failed_at, f.resolved_at, f.resolution_note, p.name AS project_name, s.known_resolution
  FROM ({views.plain(views.FAILURE_EMBEDDINGS)}) fe JOIN ({views.plain(views.FAILURES)}) f ON f.id = fe.failure_id JOIN ({views.plain(views.PROJECTS)}) p ON p.id = f.project_id LEFT JOIN ({views.plain(views.SIGNATURES)}) s ON s.id = f.signature_id)"""
_SENT = "list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))"
_SHAPE = "project_name, category, error_message, round(s, 4) AS similarity, strftime(failed_at, '%Y-%m-%dT%H:%M:%S') AS occurred_at, coalesce(nullif(known_resolution, ''), resolution_note) AS resolution, resolved_at IS NOT NULL AS resolved"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query(f"""WITH q AS (SELECT {_SENT} AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS similarity FROM embeddings, q
  ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cosine(F.col("embedding"), retrieve.vector_literal(_vector(spark, sf_dir, 0)))
    return table(spark, sf_dir, "embeddings").withColumn("s", s).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 4).alias("similarity"))


@query(f"""WITH {_CORPUS}, q AS (SELECT {_SENT} AS v FROM embeddings WHERE vec_id = 5), r AS (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM corpus, q WHERE team_id = 0 AND failure_id <> 5)
  SELECT failure_id, {_SHAPE} FROM r WHERE s >= 0.1 ORDER BY resolved_at IS NOT NULL DESC, (category = 'C3') DESC NULLS FIRST, s DESC, failure_id LIMIT 5""")
def similar_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.similar_failures(_corpus(spark, sf_dir), _vector(spark, sf_dir, 5), 0, "C3", 5, threshold=0.1)


@query(f"""WITH {_CORPUS}, q AS (SELECT failure_id AS query_id, team_id AS tq, {_SENT} AS v, category AS cq FROM corpus WHERE failure_id % 100 = 0),
  r AS (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM corpus JOIN q ON team_id = tq WHERE failure_id <> query_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY resolved_at IS NOT NULL DESC, (category = cq) DESC NULLS FIRST, s DESC, failure_id) AS rank FROM r WHERE s >= 0.1)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, failure_id, {_SHAPE} FROM k WHERE rank <= 5""")
def similar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    q = corpus.where("failure_id % 100 = 0").select(F.col("failure_id").alias("query_id"), "team_id", F.col("embedding").alias("vector"), "category", F.col("failure_id").alias("exclude_id"))
    return retrieve.similar_batch(corpus, q, threshold=0.1)


@query(f"""SELECT c.c_custkey AS request_id, s.hash AS hash, coalesce(s.is_known, false) AND nullif(s.known_resolution, '') IS NOT NULL AS is_known, coalesce(s.occurrence_count, 0) AS occurrence_count
  FROM customer c LEFT JOIN ({views.plain(views.SIGNATURES)}) s ON s.team_id = c.c_custkey % 5 AND s.hash = 'h' || CAST(c.c_custkey % 30 AS VARCHAR)""")
def signature_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").selectExpr("c_custkey AS request_id", "c_custkey % 5 AS team_id", "'h' || CAST(c_custkey % 30 AS STRING) AS signature_hash")
    h = retrieve.signature_history(requests, views.view(spark, sf_dir, views.SIGNATURES))
    return h.select("request_id", "history.hash", F.coalesce("history.is_known", F.lit(False)).alias("is_known"), F.coalesce("history.occurrence_count", F.lit(0).cast("long")).alias("occurrence_count"))


_CHUNKS, _DOCS = views.plain(views.KNOWLEDGE_CHUNKS), views.plain(views.KNOWLEDGE_DOCUMENTS)


@query(f"""WITH q AS (SELECT {_SENT} AS v FROM embeddings WHERE vec_id = 7), r AS (SELECT c.document_id, c.chunk_index, d.title, c.content, d.project_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), v) AS s
  FROM ({_CHUNKS}) c JOIN ({_DOCS}) d ON d.id = c.document_id, q WHERE d.is_active AND (d.project_id IS NULL OR d.project_id = 4))
  SELECT document_id, chunk_index, title, content, round(s, 4) AS similarity FROM r WHERE s >= 0.05 ORDER BY (project_id = 4) DESC NULLS FIRST, s DESC, document_id, chunk_index LIMIT 4""")
def knowledge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.knowledge(views.view(spark, sf_dir, views.KNOWLEDGE_CHUNKS), views.view(spark, sf_dir, views.KNOWLEDGE_DOCUMENTS), _vector(spark, sf_dir, 7), 1, 4, threshold=0.05)


@query(f"""SELECT c.document_id, c.chunk_index, d.title, c.content FROM ({_CHUNKS}) c JOIN ({_DOCS}) d ON d.id = c.document_id WHERE d.is_active
  AND (c.document_id, c.chunk_index) IN (SELECT n_nationkey, CAST(n_nationkey % 5 AS INTEGER) FROM nation)""")
def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS document_id", "CAST(n_nationkey % 5 AS INT) AS chunk_index")
    return retrieve.lookup_pairs(views.view(spark, sf_dir, views.KNOWLEDGE_CHUNKS), views.view(spark, sf_dir, views.KNOWLEDGE_DOCUMENTS), pairs)


_SEEDS = "SELECT r_regionkey AS query_id, 1 AS rank, r_regionkey * 3 AS document_id, 2 AS chunk_index, 0.9 AS similarity FROM {region} UNION ALL SELECT r_regionkey, 2, r_regionkey + 20, 0, 0.7 FROM {region} UNION ALL SELECT r_regionkey, 3, r_regionkey * 3, 0, 0.5 FROM {region}"


@query(f"""WITH s AS ({views.plain(_SEEDS)}), w AS (SELECT DISTINCT query_id, document_id, chunk_index + d AS chunk_index FROM s, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) o WHERE chunk_index + d >= 0),
  p AS (SELECT query_id, document_id, min(rank) AS rk, arg_max(similarity, rank) AS similarity FROM s GROUP BY 1, 2),
  f AS (SELECT w.query_id, row_number() OVER (PARTITION BY w.query_id ORDER BY p.rk, w.chunk_index) AS position, c.document_id, c.chunk_index, d.title, c.content, p.similarity
    FROM w JOIN ({_CHUNKS}) c USING (document_id, chunk_index) JOIN ({_DOCS}) d ON d.id = c.document_id AND d.is_active JOIN p ON p.query_id = w.query_id AND p.document_id = w.document_id)
  SELECT query_id, CAST(position AS INTEGER) AS position, document_id, chunk_index, title, content, CAST(similarity AS DOUBLE) AS similarity FROM f WHERE position <= 6""")
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = views.view(spark, sf_dir, _SEEDS).withColumn("similarity", F.col("similarity").cast("double"))
    return retrieve.expand_neighbours(seeds, views.view(spark, sf_dir, views.KNOWLEDGE_CHUNKS), views.view(spark, sf_dir, views.KNOWLEDGE_DOCUMENTS))


# -- ledger -----------------------------------------------------------------------

_SPENT = f"SELECT team_id, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,6))), 0) AS DOUBLE) AS spent FROM ({views.plain(views.AI_REQUESTS)}) r WHERE status = 'success' AND created_at >= date_trunc('month', TIMESTAMP '{views.AS_OF}') GROUP BY 1"


@query(_SPENT)
def month_to_date_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.month_to_date_cost(views.view(spark, sf_dir, views.AI_REQUESTS), F.lit(views.AS_OF).cast("timestamp"))


@query(f"""SELECT t.id AS team_id, CAST(t.monthly_ai_budget_usd AS DOUBLE) AS budget, round(coalesce(s.spent, 0), 6) AS spent, CASE WHEN coalesce(t.monthly_ai_budget_usd, 0) = 0 THEN 'unlimited' WHEN coalesce(s.spent, 0) >= t.monthly_ai_budget_usd THEN 'exceeded'
  WHEN coalesce(s.spent, 0) >= t.monthly_ai_budget_usd * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM ({views.plain(views.TEAMS)}) t LEFT JOIN ({_SPENT}) s ON s.team_id = t.id""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = views.view(spark, sf_dir, views.TEAMS).withColumn("monthly_ai_budget_usd", F.col("monthly_ai_budget_usd").cast("double"))
    return ledger.budget_status(teams, views.view(spark, sf_dir, views.AI_REQUESTS), F.lit(views.AS_OF).cast("timestamp"))


@query(f"SELECT id, name, team_id FROM ({views.plain(views.PROJECTS)}) p WHERE deleted_at IS NULL AND team_id = 3")
def project_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.project_context(views.view(spark, sf_dir, views.PROJECTS), 3).select("id", "name", "team_id")


_TARGET = "SELECT vec_id AS failure_id, vec_id % 40 AS signature_id, vec_id % 5 AS team_id, label AS embedding, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, 'old' AS source_text FROM {embeddings} WHERE vec_id % 3 <> 0"
_CHANGES = "SELECT vec_id AS failure_id, CAST(99 AS BIGINT) AS signature_id, CAST(9 AS BIGINT) AS team_id, label + 100 AS embedding, 'a' AS model, repeat('new ', 1500) AS source_text FROM {embeddings} WHERE vec_id % 4 < 2"


@query(f"""SELECT coalesce(t.failure_id, c.failure_id) AS failure_id, coalesce(t.model, c.model) AS model, CASE WHEN t.failure_id IS NULL THEN c.signature_id ELSE t.signature_id END AS signature_id, CASE WHEN t.failure_id IS NULL THEN c.team_id ELSE t.team_id END AS team_id,
  coalesce(c.embedding, t.embedding) AS embedding, CAST(length(coalesce(substr(c.source_text, 1, 4000), t.source_text)) AS BIGINT) AS source_chars FROM ({views.plain(_TARGET)}) t FULL JOIN ({views.plain(_CHANGES)}) c ON t.failure_id = c.failure_id AND t.model = c.model""")
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ledger.upsert_embeddings(views.view(spark, sf_dir, _TARGET), views.view(spark, sf_dir, _CHANGES))
    return merged.select("failure_id", "model", "signature_id", "team_id", "embedding", F.length("source_text").cast("long").alias("source_chars"))


_UPSERTED = ORACLES["upsert_embeddings"]


@query(_UPSERTED)
def upsert_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes in two batches through a versioned table, the second one handed over twice."""
    changes = views.view(spark, sf_dir, _CHANGES)
    table_ = VersionedTable.create(views.view(spark, sf_dir, _TARGET), new_folder(spark), ["failure_id", "model"])
    for number, part in ((0, "failure_id % 8 < 4"), (1, "failure_id % 8 >= 4"), (1, "failure_id % 8 >= 4")):
        table_.upsert(changes.where(part), ledger.upsert_embeddings, ("changes", number))
    return table_.read().select("failure_id", "model", "signature_id", "team_id", "embedding", F.length("source_text").cast("long").alias("source_chars"))


_LIMITS = "SELECT DISTINCT user_id % 5 AS team_id, CASE WHEN user_id % 5 < 4 THEN CAST(1000 * (user_id % 5) + 500 AS DOUBLE) END AS budget, CAST(10 * (user_id % 5) AS DOUBLE) AS spent FROM {events}"


@query(f"""WITH r AS (SELECT event_id AS request_id, user_id % 5 AS team_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 7 END AS cost FROM events),
  p AS (SELECT request_id, team_id, coalesce(sum(cost) OVER (PARTITION BY team_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT request_id, p.team_id AS team_id, CAST(before + spent AS DOUBLE) AS spent_before, coalesce(budget, 0) = 0 OR before + spent < budget AS admitted FROM p JOIN ({views.plain(_LIMITS)}) l ON l.team_id = p.team_id""")
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request, admitted until its team's budget ends."""
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("team_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 7).alias("cost_usd"))
    found = ledger.admitted(requests, views.view(spark, sf_dir, _LIMITS), ["request_id"])
    return found.select("request_id", "team_id", F.col("spent_before").cast("double").alias("spent_before"), "admitted")


@query("SELECT event_id, round(event_id / 1000 * CAST(0.15 AS DOUBLE) + (event_id % 700) / 1000 * CAST(0.6 AS DOUBLE), 6) AS cost_usd FROM events")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ledger.token_cost(F.col("event_id"), F.col("event_id") % 700, 0.15, 0.6).alias("cost_usd"))


# -- chunks and embedding input ---------------------------------------------------


def _doubled(text: Column) -> Column:
    """A text with its second, fourth and every other newline doubled."""

    def joined(lines: Column) -> Column:
        end = lambda i: F.when(i == F.size(lines) - 1, "").when(i % 2 == 1, "\n\n").otherwise("\n")
        return F.array_join(F.transform(lines, lambda x, i: F.concat(x, end(i))), "")

    return regex.let(F.split(text, "\n", -1), joined)


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with every second newline doubled, which makes paragraphs."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), _doubled(F.col("text")).alias("text"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_rows(_paragraphs(spark, sf_dir), "text", ["doc_id"])


@query("""WITH p AS (SELECT doc_id, replace(trim(text, ' ' || chr(9) || chr(10)), chr(10), ' ') AS p FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10))) > 600),
  s AS (SELECT doc_id, p, unnest(range(1, length(p) + 1, 500)) AS pos FROM p)
  SELECT doc_id, CAST((pos - 1) // 500 AS INTEGER) AS chunk_index, trim(substr(p, pos, 600), ' ' || chr(9) || chr(10)) AS content FROM s WHERE trim(substr(p, pos, 600), ' ' || chr(9) || chr(10)) <> ''""")
def chunk_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one paragraph each, longer than a chunk."""
    one = _documents(spark, sf_dir).withColumn("p", F.translate(regex.strip(F.col("text")), "\n", " ")).where(F.length("p") > 600)
    return chunk.chunk_rows(one, "p", ["doc_id"]).select("doc_id", "chunk_index", "content")


@query("""SELECT event_id, concat_ws(' | ', 'value ' || CAST(user_id AS VARCHAR), CASE WHEN event_type <> 'view' THEN 'category: ' || event_type END, CASE WHEN user_id % 2 = 0 THEN 'ecosystem: db' END, CASE WHEN user_id % 3 = 0 THEN 'job: test' END) AS input FROM events""")
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    category = F.when(F.col("event_type") == "view", "UNKNOWN").otherwise(F.col("event_type"))
    text = chunk.embedding_input(F.concat(F.lit(" value "), F.col("user_id").cast("string")), category, F.when(F.col("user_id") % 2 == 0, "db").otherwise(""), F.when(F.col("user_id") % 3 == 0, "test"))
    return e.select("event_id", text.alias("input"))


@query()
def chunk_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = chunk.chunk_embed(_paragraphs(spark, sf_dir), "text", "title", ["doc_id"])
    return df.select("doc_id", "chunk_index", "token_count", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"))


# -- answers ----------------------------------------------------------------------

_CAL = """least(1, greatest(0, value_)) AS s0 FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE CAST(event_id % 140 AS DOUBLE) / 100 END AS value_ FROM events) q"""


@query(f"""WITH a AS (SELECT event_id, {_CAL}), b AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least(CAST(0.97 AS DOUBLE), s0 + CAST(0.05 AS DOUBLE)) ELSE s0 END AS s FROM a),
  c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(CAST(0.98 AS DOUBLE), s + CAST(0.08 AS DOUBLE)) ELSE s END AS s FROM b), d AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN least(s, CAST(0.85 AS DOUBLE)) ELSE s END AS s FROM c)
  SELECT event_id, {rounded_sql('CASE WHEN event_id % 7 = 0 THEN least(s, CAST(0.7 AS DOUBLE)) ELSE s END', 3)} AS confidence FROM d""")
def calibrate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 11 == 0, "not a number").otherwise((i % 140 / 100).cast("string"))
    value = analyze.calibrated(raw, F.when(i % 2 == 0, "hybrid").otherwise("rules"), F.lit(0.9), F.when(i % 7 == 0, "UNKNOWN").otherwise("TEST"), i % 3 == 0, i % 5 == 0, i % 5 != 0)
    return table(spark, sf_dir, "events").select("event_id", value.alias("confidence"))


_ACTIONS = [*rules.ACTION_RISK, "reboot_world"]
_PATCH = "--- a/src/app.py\n+++ b/src/app.py\n@@ -1,2 +1,2 @@\n-x\n+y\n"


@query(f"""WITH a AS (SELECT event_id, [{', '.join(duck.text(x) for x in _ACTIONS)}][event_id % 11 + 1] AS asked, event_id % 3 = 0 AS main_, event_id % 2 = 0 AS patched FROM events),
  b AS (SELECT *, CASE WHEN asked = 'reboot_world' THEN 'manual' ELSE asked END AS known FROM a),
  c AS (SELECT *, patched AND known IN ({', '.join(duck.text(x) for x in rules.PATCHABLE)}) AS up, CASE known {' '.join(f"WHEN '{k}' THEN {rules.RISKS.index(v)}" for k, v in rules.ACTION_RISK.items())} END AS lv FROM b),
  d AS (SELECT *, CASE WHEN up THEN greatest(lv, 1) ELSE lv END AS l2 FROM c)
  SELECT event_id, CASE WHEN up THEN 'create_merge_request' ELSE known END AS action_type, ['low', 'medium', 'high', 'critical'][CASE WHEN main_ AND l2 IN (1, 2) THEN l2 + 1 ELSE l2 END + 1] AS risk, patched AS has_patch FROM d""")
def sanitize_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("event_id"), F.lit(None).cast("string")
    asked = F.get(F.array(*(F.lit(x) for x in _ACTIONS)), (i % 11).cast("int"))
    item = F.struct(F.lit("t").alias("title"), none.alias("description"), none.alias("rationale"), asked.alias("action_type"), F.lit("0.5").alias("confidence"), F.array(F.lit("f")).alias("affected_files"), F.when(i % 2 == 0, F.lit(_PATCH)).otherwise(F.lit("no diff")).alias("patch"))
    one = recommend.sanitised(F.array(item), i % 3 == 0, F.array(F.lit("./src/app.py")))
    df = table(spark, sf_dir, "events").select("event_id", F.get(one, 0).alias("r"))
    return df.select("event_id", "r.action_type", "r.risk", F.col("r.patch").isNotNull().alias("has_patch"))


@query("""SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN source <> 'src1' AND n_chars > 0 THEN 1 ELSE 0 END AS INTEGER) AS n, CAST(CASE WHEN lang = 'en' THEN least(2000, length(text)) ELSE 0 END AS BIGINT) AS chars FROM documents""")
def valid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")

    def item(kind, content):  # noqa: ANN001, ANN202
        return F.struct(kind.alias("type"), content.alias("content"), none.alias("source_ref"), F.lit(None).cast("int").alias("line_number"), none.alias("related_failure_uuid"), F.lit("x").alias("weight"))

    items = F.array(item(F.when(F.col("lang") == "en", "log_line"), F.col("text")), item(F.when(F.col("source") == "src1", "").otherwise("doc"), F.when(F.col("n_chars") > 0, "c")))
    v = analyze.valid_evidence(items)
    first = F.filter(v, lambda x: x["type"] == "log_line")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(v).alias("n"), F.coalesce(F.length(F.get(first, 0)["content"]), F.lit(0)).cast("long").alias("chars"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS in_scope FROM events")
def patch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    path = F.when(i % 4 == 0, "src/app.py").when(i % 4 == 1, "app.py").when(i % 4 == 2, "src/other.py").otherwise("src/app.py")
    hunk = F.when(i % 4 == 3, F.lit("no hunk")).otherwise(F.lit("@@ -1 +1 @@"))
    patch = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), hunk, F.lit("\n-a\n+b\n"))
    return table(spark, sf_dir, "events").select("event_id", recommend.valid_patch(patch, F.array(F.lit("src/app.py"))).isNotNull().alias("in_scope"))


_MESSAGES = ["API key not valid", "429 Too Many Requests", "Deadline Exceeded", "GenerateContent failed", "quota for unauthorized use", "read timeout", "socket closed"]


@query("""SELECT event_id, ['auth', 'rate_limit', 'timeout', 'unavailable', 'auth', 'timeout', 'unavailable'][event_id % 7 + 1] AS kind, [401, 429, 504, 503, 401, 504, 503][event_id % 7 + 1] AS status, event_id % 7 NOT IN (0, 4) AS retryable FROM events""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.get(F.array(*(F.lit(x) for x in _MESSAGES)), (F.col("event_id") % 7).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", providers.error_kind(message).alias("e"))
    return df.select("event_id", "e.kind", "e.status", "e.retryable")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TEST' WHEN 1 THEN 'DOCKER' WHEN 2 THEN 'BUILD' END AS category FROM events")
def salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 4
    text = F.when(i == 0, 'Sure:\n```json\n{"category": "TEST"}\n```').when(i == 1, 'here {"category": "DOCKER", "summary": "x"} ok').when(i == 2, '{"category": "BUILD"}').otherwise("no json at all")
    return table(spark, sf_dir, "events").select("event_id", providers.salvage(text)["category"].alias("category"))


@query("""WITH a AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS r, CAST(event_id * 7 % 103 AS DOUBLE) / 102 AS m, event_id % 3 = 0 AS same, event_id % 10 = 9 AS no_ml FROM events)
  SELECT event_id, CASE WHEN r >= 0.85 OR no_ml THEN 'rules' WHEN same AND r > 0 THEN 'hybrid' WHEN m >= 0.85 THEN 'ml' WHEN greatest(r, m) < 0.5 THEN 'llm' WHEN r >= m THEN 'rules' ELSE 'ml' END AS source,
    round(CASE WHEN r >= 0.85 OR no_ml THEN r WHEN same AND r > 0 THEN least(0.97, greatest(r, m) + 0.1) WHEN m >= 0.85 THEN m WHEN greatest(r, m) < 0.5 THEN greatest(r, m) WHEN r >= m THEN r ELSE m END, 4) AS confidence FROM a""")
def hybrid_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rule = F.struct(F.lit("TEST").alias("category"), F.lit("UnitTest").alias("subcategory"), (i % 101 / 100).alias("confidence"), F.lit("rules").alias("source"), F.array(F.lit("TEST/UnitTest")).alias("matched_rules"))
    ml = F.when(i % 10 != 9, F.struct(F.when(i % 3 == 0, "TEST").otherwise("BUILD").alias("category"), (i * 7 % 103 / 102).alias("confidence")))
    c = classify.cascade(rule, ml)
    return table(spark, sf_dir, "events").select("event_id", c["source"].alias("source"), F.round(c["confidence"], 4).alias("confidence"))


@query()
def model_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained classifier over documents, fitted on their quality labels as two classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS category"), "doc_id")
    m = classify.classify_model(docs, classify.train_model(labelled))
    return m.select("doc_id", "ml.category", F.round("ml.confidence", 4).alias("confidence"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis requests made from the logs."""
    df = extract.extract(extract.clean(logs(spark, sf_dir), "raw_log"))
    s = lambda x: f"CAST(NULL AS {x})"
    files = "array(named_struct('path', 'src/app.py', 'change_type', 'modified', 'additions', 1, 'deletions', 1, 'is_config', false, 'is_dependency', false, 'patch', 'x', 'patch_truncated', false))"
    built = df.selectExpr(
        "log_id AS request_id", "'v1' AS contract_version", "team_id",
        "named_struct('uuid', CAST(log_id AS STRING), 'occurrence_index', CAST(log_id % 3 AS INT), 'is_flaky', log_id % 9 = 0, 'signature_hash', 'h' || CAST(log_id % 30 AS STRING), 'ecosystem', extraction.ecosystem) AS failure",
        f"named_struct('id', project_id, 'uuid', {s('STRING')}, 'name', 'p' || CAST(project_id AS STRING), 'tech_stack', array('python'), 'provider', {s('STRING')}, 'default_branch', 'main') AS project",
        f"named_struct('iid', 1, 'ref', CASE WHEN log_id % 4 = 0 THEN 'main' ELSE 'feature' END, 'source', 'push', 'commit_sha', {s('STRING')}, 'commit_message', {s('STRING')}, 'duration_seconds', 10, 'previous_status', 'success', 'changed_files', {files}) AS pipeline",
        "named_struct('name', 'unit', 'stage_name', 'test', 'status', 'failed', 'exit_code', extraction.exit_code, 'duration_seconds', 90, 'failure_reason', CAST(NULL AS STRING), 'baseline_duration_seconds', 30.0D) AS job",
        "extraction.excerpt AS log_excerpt", "extraction.error_block AS error_block", "extraction.stack_trace AS stack_trace",
        "CAST(array() AS array<struct<path:string,line:int,start_line:int,end_line:int,content:string>>) AS source_context", "true AS use_rag", "log_id % 5 <> 4 AS use_llm", "false AS force_llm", f"{s('STRING')} AS llm_override",
    )
    return built


def _sources(spark: SparkSession, sf_dir: str) -> pipeline.Sources:
    """Failures and knowledge chunks with embeddings of the stand-in encoder, of which requests' are."""
    v = lambda sql: views.view(spark, sf_dir, sql)
    encoder = partial(chunk.HashedEncoder, 64)
    failures = v(views.FAILURES)
    embedded = chunk.embed(failures.select(F.col("id").alias("failure_id"), (F.col("project_id") % 5).alias("team_id"), "error_message"), "error_message", encoder=encoder).drop("error_message")
    chunks = chunk.embed(v(views.KNOWLEDGE_CHUNKS).drop("embedding"), "content", encoder=encoder)
    return pipeline.Sources(retrieve.failure_corpus(embedded, failures, v(views.PROJECTS), v(views.SIGNATURES)), chunks, v(views.KNOWLEDGE_DOCUMENTS), encoder)


@query()
def analyze_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log as a request, answered by history, by the rules or by the canned provider."""
    teams = views.view(spark, sf_dir, views.TEAMS).withColumn("monthly_ai_budget_usd", F.col("monthly_ai_budget_usd").cast("double"))
    found = pipeline.analyze(requests(spark, sf_dir), views.view(spark, sf_dir, views.SIGNATURES), teams, views.view(spark, sf_dir, views.AI_REQUESTS), F.lit(views.AS_OF).cast("timestamp"), _sources(spark, sf_dir))
    a = F.col("analysis")
    return found.select("request_id", "status", a["category"].alias("category"), a["severity"].alias("severity"), a["confidence"].alias("confidence"), a["usage"]["provider"].alias("provider"), F.size(a["evidence"]).alias("n_evidence"), F.size(a["recommendations"]).alias("n_recommendations"))
