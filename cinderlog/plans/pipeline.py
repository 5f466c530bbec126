"""The composed plans: a raw log to its response row, a failure to its analysis."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.operators import analyze as answers
from cinderlog.operators import chunk, classify, extract, ledger, prompt, providers, redact, retrieve, signature, vector_index
from cinderlog.operators.answers import AnswerLog, Pace, complete
from cinderlog.operators.vector_index import VectorIndex
from cinderlog.settings import DEFAULTS, Settings
from cinderlog.workers import materialised


def process_logs(logs: DataFrame, column: str = "raw_log", strict: bool | Column = True, model: PipelineModel | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """logs with redaction, cleaned, extraction, signature_hash, classification and reduction.

    One narrow stage: nothing is shuffled, so it scales with the input's partitions. Each result is one
    expression. A pass over the raw text and one over the cleaned text find the literals of all rules, families and
    causes; the passes are also where a filter on a result stops, so what comes before them runs once.
    """
    df = redact.redact(logs, column, "redaction", strict, settings=settings)
    df = extract.clean(df, "redaction.text", "cleaned")
    families, causes, runs = extract.prefilter(), classify.prefilter(), signature.prefilter()
    found = Prefilter([*families.sets, *causes.sets, *runs.sets])
    df = df.withColumn("__bits", found.column(F.col("cleaned")))
    gates = found.gates(F.col("__bits"))
    of_families, of_causes, of_runs = gates[: len(families.sets)], gates[len(families.sets) : -len(runs.sets)], gates[-len(runs.sets) :]
    df = extract.extract(df, "cleaned", "extraction", settings, of_families)
    e = F.col("extraction")
    # what is classified is a part of the cleaned text, so its literals are among those found
    df = df.withColumn("__basis", signature.basis(e["error_block"], e["error_message"], F.col("cleaned")))
    df = signature.normalise(df, "__basis", "normalised", settings, of_runs)
    df = df.withColumn("signature_hash", signature.signature_hash(e["ecosystem"], F.col("normalised")))
    df = classify.classify(df, "__basis", "classification", model, gates=of_causes)
    original, kept = F.length(F.col(column)), F.length(e["excerpt"])
    df = df.withColumn("reduction", F.struct(original.alias("original_chars"), kept.alias("excerpt_chars"), extract.reduction_ratio(original, kept).alias("ratio")))
    if "exit_code" in logs.columns:
        df = df.withColumn("exit_code", F.coalesce(F.nullif(e["exit_code"], F.lit(0)), F.col("exit_code")))
    return df.drop("__bits", "__basis")


def similar(requests: DataFrame, corpus: DataFrame | VectorIndex, encoder: Callable[[], chunk.Encoder] = chunk.HashedEncoder, settings: Settings = DEFAULTS) -> DataFrame:
    """The most similar failures for each request (query_id, team_id, error_message, category, ecosystem, job_name, exclude_failure_id)."""
    text = chunk.embedding_input(F.col("error_message"), F.col("category"), F.col("ecosystem"), F.col("job_name"))
    queries = chunk.embed(requests.withColumn("__text", text), "__text", "vector", encoder, settings)
    return retrieve.similar_batch(corpus, queries.select("query_id", "team_id", "vector", "category", F.col("exclude_failure_id").alias("exclude_id")), settings=settings)


@dataclass(frozen=True)
class Sources:
    """What retrieval inside an analysis looks through, as tables or as indexes over them; embeddings are of `encoder`."""

    corpus: DataFrame | VectorIndex | None = None
    chunks: DataFrame | VectorIndex | None = None
    documents: DataFrame | None = None
    encoder: Callable[[], chunk.Encoder] = chunk.HashedEncoder


_SIMILAR = "array<struct<similarity:double,project_name:string,resolution:string>>"
_KNOWLEDGE = "array<struct<title:string,content:string,similarity:double>>"


def started(spark: SparkSession, *builds: Callable[[], Any]) -> list[Future]:
    """Each of builds begun in a thread of its own, for tables that don't depend on each other: most of their time is planning
    and waiting for a few tasks. An error comes up where a result is asked for."""
    pool = ThreadPoolExecutor(max(1, len(builds)))
    out = [pool.submit(inheritable_thread_target(spark)(x)) for x in builds]
    pool.shutdown(wait=False)
    return out


def indexes(spark: SparkSession, sources: Sources) -> tuple[Future, Future]:
    """The indexes over both sources, begun; none for a source that isn't there."""
    made = lambda x: isinstance(x, VectorIndex) or x is None
    corpus = (lambda: sources.corpus) if made(sources.corpus) else lambda: vector_index.build(sources.corpus)
    chunks = (lambda: sources.chunks) if made(sources.chunks) or sources.documents is None else lambda: retrieve.knowledge_index(sources.chunks, sources.documents)
    return tuple(started(spark, corpus, chunks))


def _question(*parts: Column) -> Column:
    """A digest that tells rows of parts apart: each with its length, null not as empty."""
    text = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.sha2(F.concat(*(text(x.cast("string")) for x in parts)), 256)


def retrieved(requests: DataFrame, sources: Sources, settings: Settings = DEFAULTS, built: tuple[Future, Future] | None = None) -> DataFrame:
    """request_id, similar, knowledge of the requests whose texts could be encoded.

    requests: request_id, team_id, project_id, category, error_message, ecosystem, job_name.
    Similar failures, and the knowledge chunks most like category and error with those around them.
    built: indexes() of the sources, where they were begun before.

    Failures come again and again: requests of a team with the same texts ask one question, which is encoded and looked up once.
    The project tells questions apart only where chunks of the team's belong to it; all other projects find the same.
    """
    spark = requests.sparkSession
    corpus, seen = built or indexes(spark, sources)
    like = chunk.embedding_input(F.col("error_message"), F.col("category"), F.col("ecosystem"), F.col("job_name"))
    about = chunk.knowledge_query(F.col("category"), F.col("error_message"), settings)
    requests = requests.select("request_id", "team_id", "project_id", "category", like.alias("__like"), about.alias("__about"))
    requests = requests.withColumn("question", _question(*(F.col(x) for x in ("team_id", "category", "__like", "__about"))))
    vectors = {"__s": "__like"} if sources.corpus is not None else {}
    knows = sources.chunks is not None and (sources.documents is not None)
    # a question at a place: in a project with chunks of its own, in any other one, or in none
    where = F.lit("none")
    if knows:
        own = retrieve.own_projects(seen.result())
        requests = requests.join(own.withColumn("__own", F.lit(True)), ["team_id", "project_id"], "left")
        where = F.when(F.col("__own"), F.concat(F.lit("="), F.col("project_id").cast("string"))).when(F.col("project_id").isNotNull(), "other").otherwise("none")
    requests = requests.withColumn("place", F.concat_ws("/", "question", where))
    texts = ["question", "team_id", "category", "__like", "__about"]
    places = materialised(requests.groupBy("place", *texts).agg(F.min("project_id").alias("project_id")))
    asked, encoded = places.select(*texts).distinct(), vectors | ({"__k": "__about"} if knows else {})
    for out, text in encoded.items():
        asked = chunk.embed(asked, text, out, sources.encoder, settings, degrade=True)
    asked = materialised(asked.drop("__like", "__about")).where(reduce(and_, (F.col(x).isNotNull() for x in encoded), F.lit(True)))
    places = places.select("question", "place", "project_id")

    def similar_rows() -> DataFrame:
        queries = asked.select(F.col("question").alias("query_id"), "team_id", F.col("__s").alias("vector"), "category", F.lit(None).cast("long").alias("exclude_id"))
        rows = retrieve.similar_batch(corpus.result(), queries, settings=settings)
        return rows.groupBy(F.col("query_id").alias("question")).agg(F.array_sort(F.collect_list(F.struct("rank", "similarity", "project_name", "resolution"))).alias("similar"))

    def knowledge_rows() -> DataFrame:
        queries = places.join(asked, "question").select(F.col("place").alias("query_id"), "team_id", "project_id", F.col("__k").alias("vector"))
        seeds = retrieve.knowledge_batch(seen.result(), sources.documents, queries, settings=settings)
        chunks = sources.chunks.rows if isinstance(sources.chunks, VectorIndex) else sources.chunks
        rows = retrieve.expand_neighbours(seeds, chunks, sources.documents, settings)
        return rows.groupBy(F.col("query_id").alias("place")).agg(F.array_sort(F.collect_list(F.struct("position", "title", "content", "similarity"))).alias("knowledge"))

    wanted = {"similar": similar_rows} if sources.corpus is not None else {}
    wanted |= {"knowledge": knowledge_rows} if knows else {}
    parts = dict(zip(wanted, started(spark, *wanted.values()), strict=True))
    found = places.select("question", "place").join(asked.select("question"), "question")
    for name, by in (("similar", "question"), ("knowledge", "place")):
        found = found.join(parts[name].result(), by, "left") if name in parts else found.withColumn(name, F.lit(None))
    pick = lambda c, names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    found = found.select(
        "place", pick(F.col("similar").cast("array<struct<rank:int,similarity:double,project_name:string,resolution:string>>"), ("similarity", "project_name", "resolution")).alias("similar"),
        pick(F.col("knowledge").cast("array<struct<position:int,title:string,content:string,similarity:double>>"), ("title", "content", "similarity")).alias("knowledge"),
    )
    return requests.select("request_id", "place").join(materialised(found).hint("merge"), "place").drop("place")  # few bytes may hold many chunks, so they aren't broadcast


def analyze(
    requests: DataFrame, signatures: DataFrame, teams: DataFrame | None = None, ledger_rows: DataFrame | None = None, as_of: Column | None = None, sources: Sources | None = None, model: PipelineModel | None = None,
    make_provider: Callable[[str | None], providers.Provider] | None = None, settings: Settings = DEFAULTS, rates: tuple[float, float] = (0.0, 0.0), answer_log: AnswerLog | None = None, pace: Pace = Pace(), redact_all: bool = True,
) -> DataFrame:
    """request_id, analysis, status, error, degraded of each request (request_id and the request's fields).

    Requests of known signatures and those that want no model are split off by filters before
    a prompt is built, so a provider is asked for the others only. Retrieval looks through
    `sources` for requests that want it and whose signature has no known resolution; where it
    can't be done, for one request or for all, the analysis goes on without and says so (`degraded`).

    Within the month's budget a team's requests are admitted in the order of their request_id, until what was spent and what
    those before are expected to cost (by `rates`, dollars per 1,000 prompt and answer tokens) reaches it; others get status
    "budget_exceeded" and no model's answer. A provider's failure gives status "provider_error", the rules' answer and
    the error's kind, code, status and whether it may be tried again. make_provider: a provider for a request's
    llm_override (JSON or null); answers are kept in answer_log, if there is one, and each prompt is asked once.

    Nothing is stored before it is redacted, the log excerpt always, the request's other texts unless redact_all is
    false (then they are used as they are, and stored). llm_override is never stored: it is taken from `requests` when providers
    are asked. Intermediate tables lie in the folder of spark.checkpoint.dir; delete them once the result is written.
    """
    fields, basis, causes = [c for c in requests.columns if c not in ("request_id", "llm_override")], F.coalesce(regex.nonempty(F.col("error_block")), F.col("log_excerpt")), classify.prefilter()
    df = redact.redact_request(requests.withColumn("__raw", basis), settings, redact_all, {"__bits_of_raw": (causes, F.col("__raw"))})
    df = df.withColumns({"__excerpt": F.col("log_excerpt"), "__basis": basis})
    # literals were found before redaction, which may make new ones: what it changed is tried with all rules
    df = df.withColumn("__changed", ~F.col("__basis").eqNullSafe(F.col("__raw")))
    df = classify.classify(df, "__basis", "__c", model, gates=[F.col("__changed") | x for x in causes.gates(F.col("__bits_of_raw"))])
    df = df.withColumns({"__request": F.struct(*fields), "signature_hash": F.col("failure.signature_hash")})
    df = retrieve.signature_history(df, signatures)
    history, wants_rag = F.col("history"), F.coalesce(F.col("use_rag"), F.lit(True))
    df = df.withColumns({
        "__known": wants_rag & F.coalesce(history["is_known"], F.lit(False)),
        "__asks": F.coalesce(F.col("use_llm"), F.lit(True)),
        "__rag": wants_rag,
    })
    df = df.withColumn("__short", F.col("__known") & (F.col("__c.confidence") >= 0.85) & ~F.coalesce(F.col("force_llm"), F.lit(False)))
    built = indexes(requests.sparkSession, sources) if sources is not None else None  # meanwhile
    df = materialised(df.select("request_id", "team_id", "__request", "__c", "__excerpt", "history", "__known", "__short", "__asks", "__rag"))  # the branches read it
    none = {"similar": F.lit(None).cast(_SIMILAR), "knowledge": F.lit(None).cast(_KNOWLEDGE), "__failed": F.lit(False)}
    if sources is not None:
        looks = F.col("__rag") & ~F.col("__known")
        r = F.col("__request")
        asking = df.where(looks).select(
            "request_id", "team_id", r["project"]["id"].alias("project_id"), F.col("__c.category").alias("category"), F.coalesce(regex.nonempty(regex.strip(r["error_block"])), F.col("__excerpt"), F.lit("")).alias("error_message"),
            r["failure"]["ecosystem"].alias("ecosystem"), r["job"]["name"].alias("job_name"),
        )
        context, _ = retrieve.safely(lambda: materialised(retrieved(asking, sources, settings, built)), df.select("request_id", none["similar"].alias("similar"), none["knowledge"].alias("knowledge")).limit(0))
        # a request without a row in the context is one that retrieval gave up on
        df = df.join(context.withColumn("__there", F.lit(True)), "request_id", "left").withColumn("__failed", looks & F.col("__there").isNull()).drop("__there")
    else:
        df = df.withColumns(none)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    df = df.withColumn("__used", F.col("__rag") & (F.col("history").isNotNull() | some("similar") | some("knowledge")))
    request, c, wants_rag = F.col("__request"), F.col("__c"), F.col("__rag")

    def rows(of: DataFrame, analysis: Column, status: str, error: Column | None = None) -> DataFrame:
        error = F.lit(None).cast(providers.ERROR) if error is None else error
        return of.select("request_id", analysis.alias("analysis"), F.lit(status).alias("status"), error.alias("error"), F.col("__failed").alias("degraded"))

    by_rules = answers.rules_answer(c, F.col("__used"))
    out = [rows(df.where("__short"), answers.known_answer(request, c, history), "known_signature"), rows(df.where("NOT __short AND NOT __asks"), by_rules, "rules")]
    rest = df.where("NOT __short AND __asks")
    rest = rest.withColumn("__prompt", prompt.render("__request", "__c", F.col("__excerpt"), F.col("similar"), F.col("knowledge"), history))
    if teams is not None and ledger_rows is not None:
        budget = ledger.budget_status(teams, ledger_rows, as_of if as_of is not None else F.current_timestamp(), settings)
        expected = ledger.token_cost(F.floor(F.length("__prompt") / settings.chars_per_token), F.lit(settings.expected_answer_tokens), *rates)
        # written first: dealing by ranges looks through its rows twice, and each would need its prompt twice
        turns = ledger.admitted(materialised(rest.select("request_id", "team_id", expected.alias("cost_usd"))), budget, ["request_id"])
        rest = rest.join(turns.select("request_id", "admitted"), "request_id")
        out.append(rows(rest.where("NOT admitted"), by_rules, "budget_exceeded", providers.error_row(F.lit("budget"), F.lit("The team's monthly budget is used up."))))
        rest = rest.where("admitted")
    if make_provider is None:
        rest = providers.stub(rest, "__prompt", "__answer")
        usage = F.col("__answer_usage")
    else:
        if "llm_override" in requests.columns:
            rest = rest.join(requests.select("request_id", F.col("llm_override").cast("string").alias("__override")), "request_id")
        asked = complete(rest, "__prompt", make_provider, "__reply", "__override" if "llm_override" in requests.columns else None, answer_log, pace)
        rest = materialised(asked.drop("__override", "__reply_key"))  # the branches read it
        reply = F.col("__reply")
        out.append(rows(rest.where("__reply.error_kind IS NOT NULL"), by_rules, "provider_error", providers.error_row(reply["error_kind"], reply["error_message"])))
        rest = rest.where("__reply.error_kind IS NULL").withColumn("__answer", providers.salvage(reply["text"]))
        usage = reply
    out.append(rows(rest, answers.model_answer(request, c, history, wants_rag, F.col("__used"), F.col("__answer"), usage, settings), "model"))
    return reduce(DataFrame.unionByName, out)


def service_info(settings: Settings = DEFAULTS) -> dict:
    """What this engine is: versions, rule counts and thresholds."""
    return {"service_version": settings.service_version, "contract_version": settings.contract_version, "rules": len(rules.CAUSES), "redactions": len(rules.REDACTIONS) + 1, "categories": rules.CATEGORIES, "embedding_dimensions": settings.embedding_dimensions}
