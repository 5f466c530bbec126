"""What is done with an answer: calibrated confidence, evidence that holds, and the row that goes back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions import regex
from cinderlog.functions.numbers import rounded
from cinderlog.operators.recommend import clamp, sanitised
from cinderlog.settings import DEFAULTS, Settings

MAX_EVIDENCE, EVIDENCE_CHARS, SUMMARY_CHARS = 8, 2000, 500


def calibrated(raw: Column, source: Column, rule_confidence: Column, category: Column, is_known: Column, retrieved: Column, used: Column) -> Column:
    """A stated confidence after what else is known: agreement and history raise it, silence caps it."""
    score = clamp(raw)
    score = F.when((source == "hybrid") & (rule_confidence >= 0.85), F.least(F.lit(0.97), score + 0.05)).otherwise(score)
    score = F.when(F.coalesce(is_known, F.lit(False)), F.least(F.lit(0.98), score + 0.08)).otherwise(score)
    score = F.when(retrieved & ~used, F.least(score, F.lit(0.85))).otherwise(score)
    score = F.when(category == "UNKNOWN", F.least(score, F.lit(0.70))).otherwise(score)
    return rounded(score, 3)


def valid_evidence(items: Column) -> Column:
    """Evidence with a type and content, cut and weighted, the first eight."""
    good = F.filter(items, lambda x: regex.nonempty(x["type"]).isNotNull() & regex.nonempty(x["content"]).isNotNull())
    shaped = F.transform(
        good,
        lambda x: F.struct(
            x["type"].alias("type"), regex.head(x["content"], EVIDENCE_CHARS).alias("content"), x["source_ref"].alias("source_ref"), x["line_number"].alias("line_number"),
            x["related_failure_uuid"].alias("related_failure_uuid"), clamp(x["weight"]).alias("weight"),
        ),
    )
    return F.slice(shaped, 1, MAX_EVIDENCE)


def shown_files(changed_files: Column, source_context: Column) -> Column:
    """Paths whose content a model saw."""
    with_patch = F.transform(F.filter(changed_files, lambda f: regex.nonempty(f["patch"]).isNotNull()), lambda f: f["path"])
    windows = F.transform(source_context, lambda w: w["path"])
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(with_patch, none), F.coalesce(windows, none))


def _usage(provider: Column, model: Column, tokens_in: Column, tokens_out: Column, cost: Column, cache_hit: Column) -> Column:
    return F.struct(provider.alias("provider"), model.alias("model"), tokens_in.cast("int").alias("prompt_tokens"), tokens_out.cast("int").alias("completion_tokens"), cost.cast("double").alias("cost_usd"), cache_hit.alias("cache_hit"))


_NO_RECOMMENDATIONS = "array<struct<title:string,description:string,rationale:string,action_type:string,risk:string,confidence:double,affected_files:array<string>,patch:string>>"
_NO_EVIDENCE = "array<struct<type:string,content:string,source_ref:string,line_number:int,related_failure_uuid:string,weight:double>>"


def _row(classification: Column, **values: Column) -> Column:
    order = ("category", "subcategory", "severity", "confidence", "summary", "root_cause", "explanation", "is_transient", "retry_recommended", "evidence", "recommendations", "used_rag", "usage")
    fixed = {"classification_source": classification["source"], "classification_confidence": classification["confidence"]}
    return F.struct(*(values[x].alias(x) for x in order), *(v.alias(k) for k, v in fixed.items()))


def known_answer(request: Column, classification: Column, history: Column) -> Column:
    """The answer to a signature with a confirmed resolution; no model is asked."""
    text = F.lit(None).cast("string")
    default = request["pipeline"]["ref"] == request["project"]["default_branch"]
    cause, fix = history["known_root_cause"], history["known_resolution"]
    evidence = F.array(F.struct(F.lit("historical_failure").alias("type"), F.concat(F.lit("Confirmed resolution: "), F.coalesce(fix, F.lit(""))).alias("content"), F.concat(F.lit("signature:"), regex.head(F.coalesce(history["hash"], F.lit("")), 12)).alias("source_ref"), F.lit(None).cast("int").alias("line_number"), text.alias("related_failure_uuid"), F.lit(0.95).alias("weight")))
    advice = F.array(F.struct(regex.head(F.coalesce(regex.nonempty(fix), F.lit("Apply the known resolution")), 200).alias("title"), F.lit("It resolved this signature before.").alias("description"), text.alias("rationale"), F.lit("investigate").alias("action_type"), F.lit("low").alias("risk"), F.lit(0.95).alias("confidence"), F.array().cast("array<string>").alias("affected_files"), text.alias("patch")))
    return _row(
        classification, category=F.coalesce(regex.nonempty(history["category"]), classification["category"]), subcategory=F.coalesce(regex.nonempty(history["subcategory"]), classification["subcategory"]),
        severity=F.when(default, "high").otherwise("medium"), confidence=F.lit(0.95), summary=regex.head(F.coalesce(regex.nonempty(cause), F.lit("A known failure came back.")), SUMMARY_CHARS), root_cause=F.coalesce(cause, F.lit("")),
        explanation=F.concat(F.lit("Seen "), F.coalesce(history["occurrence_count"], F.lit(0)).cast("string"), F.lit(" times, with a confirmed resolution; no model was asked.")), is_transient=F.lit(False), retry_recommended=F.lit(False),
        evidence=evidence.cast(_NO_EVIDENCE), recommendations=advice.cast(_NO_RECOMMENDATIONS), used_rag=F.lit(True), usage=_usage(F.lit("none"), F.lit("known_signature"), F.lit(0), F.lit(0), F.lit(0.0), F.lit(True)),
    )


def rules_answer(classification: Column, used: Column) -> Column:
    """The answer where no model is wanted."""
    return _row(
        classification, category=classification["category"], subcategory=classification["subcategory"], severity=F.lit("medium"), confidence=classification["confidence"],
        summary=F.concat(classification["category"], F.lit(" failure by the rules.")), root_cause=F.lit("No model was asked."), explanation=F.lit(None).cast("string"), is_transient=F.lit(False), retry_recommended=F.lit(False),
        evidence=F.array().cast(_NO_EVIDENCE), recommendations=F.array().cast(_NO_RECOMMENDATIONS), used_rag=used, usage=_usage(F.lit("none"), F.lit("rules"), F.lit(0), F.lit(0), F.lit(0.0), F.lit(False)),
    )


def model_answer(request: Column, classification: Column, history: Column, retrieved: Column, used: Column, answer: Column, usage: Column, settings: Settings = DEFAULTS) -> Column:
    """A model's answer made safe, with the classifier's values where it gave none."""
    default = request["pipeline"]["ref"] == request["project"]["default_branch"]
    shown = shown_files(request["pipeline"]["changed_files"], request["source_context"])
    confidence = calibrated(answer["confidence"], classification["source"], classification["confidence"], classification["category"], history["is_known"], retrieved, used)
    no = F.lit(False)
    return _row(
        classification, category=F.coalesce(regex.nonempty(answer["category"]), classification["category"]), subcategory=F.coalesce(regex.nonempty(answer["subcategory"]), classification["subcategory"]),
        severity=F.coalesce(answer["severity"], F.lit("medium")), confidence=confidence, summary=regex.head(F.coalesce(answer["summary"], F.lit("")), SUMMARY_CHARS), root_cause=F.coalesce(answer["root_cause"], F.lit("")), explanation=answer["explanation"],
        is_transient=F.coalesce(answer["is_transient"], no), retry_recommended=F.coalesce(answer["retry_recommended"], no), evidence=valid_evidence(answer["evidence"]).cast(_NO_EVIDENCE),
        recommendations=sanitised(answer["recommendations"], default, shown).cast(_NO_RECOMMENDATIONS), used_rag=used, usage=_usage(usage["provider"], usage["model"], usage["prompt_tokens"], usage["completion_tokens"], usage["cost_usd"], no),
    )
