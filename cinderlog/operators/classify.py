"""Causes of failures: weighted rules, a trained model, and the cascade of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter, whole
from cinderlog.functions.numbers import rounded
from cinderlog.settings import DEFAULTS, Settings

RESULT = "struct<category:string,subcategory:string,confidence:double,source:string,matched_rules:array<string>>"


def prefilter(causes: Sequence[rules.Cause] = tuple(rules.CAUSES)) -> Prefilter:
    """Which rules can hit a text."""
    return Prefilter.of_patterns([x.pattern for x in causes])


def rule_hits(text: Column, causes: Sequence[rules.Cause] = tuple(rules.CAUSES), gates: Sequence[Column] | None = None) -> Column:
    """array<struct<category, subcategory, idx, hits, score>> of the rules that hit, in their order; gates: which are tried."""
    found = []
    for i, (c, gate) in enumerate(zip(causes, gates or [F.lit(True)] * len(causes), strict=True)):
        hits = regex.count(text, c.pattern, "im")
        found.append(F.when(gate, F.struct(F.lit(c.category).alias("category"), F.lit(c.subcategory).alias("subcategory"), F.lit(i).alias("idx"), hits.alias("hits"), F.lit(c.weight).alias("weight"))))
    hit = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["hits"] > 0))
    return F.transform(
        hit,
        lambda x: F.struct(
            x["category"].alias("category"), x["subcategory"].alias("subcategory"), x["idx"].alias("idx"), x["hits"].alias("hits"), (x["weight"] * F.least(1 + (x["hits"] - 1) * 0.1, F.lit(1.5))).alias("score")
        ),
    )


def hits(df: DataFrame, column: str, out: str = "hits", causes: Sequence[rules.Cause] = tuple(rules.CAUSES)) -> DataFrame:
    """Adds `out` as rule_hits() gives it; only rules of which the text has a literal are tried."""
    found, bits = prefilter(causes), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.col(column)))
    return df.withColumn(out, regex.let(F.col(column), lambda t: rule_hits(t, causes, found.gates(F.col(bits))))).drop(bits)


def category_scores(hits: Column) -> Column:
    """array<struct<score, first, category>>: scores added up in rule order."""
    names = F.array_distinct(F.transform(hits, lambda x: x["category"]))

    def one(name: Column) -> Column:
        own = F.filter(hits, lambda x: x["category"] == name)
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["score"])
        return F.struct(total.alias("score"), (-F.array_min(F.transform(own, lambda x: x["idx"]))).alias("first"), name.alias("category"))

    return F.transform(names, one)


def classified(text: Column, causes: Sequence[rules.Cause] = tuple(rules.CAUSES), gates: Sequence[Column] | None = None) -> Column:
    """RESULT by the rules alone; UNKNOWN where none hits or the text is empty."""

    def with_scores(hits: Column) -> Column:
        return F.struct(hits.alias("hits"), category_scores(hits).alias("scores"))

    def with_best(x: Column) -> Column:
        return F.struct(x["hits"].alias("hits"), x["scores"].alias("scores"), F.array_max(x["scores"]).alias("best"))

    def result(x: Column) -> Column:
        best, hits = x["best"], x["hits"]
        own = F.filter(hits, lambda y: y["category"] == best["category"])
        strongest = F.array_max(F.transform(own, lambda y: F.struct(y["score"].alias("score"), (-y["idx"]).alias("first"), y["subcategory"].alias("subcategory"))))
        rivals = F.filter(x["scores"], lambda y: ~y["category"].isin(*rules.SYMPTOMS) | best["category"].isin(*rules.SYMPTOMS))
        total = F.aggregate(rivals, F.lit(0.0), lambda a, y: a + y["score"])
        confidence = rounded(F.least(F.lit(0.98), F.try_divide(best["score"], total) * F.least(best["score"], F.lit(1.0))), 3)
        names = F.array_sort(F.array_distinct(F.transform(hits, lambda y: F.concat(y["category"], F.lit("/"), y["subcategory"]))))
        some, none = F.size(hits) > 0, F.array().cast("array<string>")
        return F.struct(
            F.when(some, best["category"]).otherwise(F.lit("UNKNOWN")).alias("category"), F.when(some, strongest["subcategory"]).alias("subcategory"),
            F.when(some, confidence).otherwise(0.0).alias("confidence"), F.lit("rules").alias("source"), F.when(some, names).otherwise(none).alias("matched_rules"),
        )

    hits = regex.let(text, lambda t: rule_hits(t, causes, gates))
    return regex.let(regex.let(regex.let(hits, with_scores), with_best), result)


def classify_rules(df: DataFrame, column: str, out: str = "classification", causes: Sequence[rules.Cause] = tuple(rules.CAUSES), gates: Sequence[Column] | None = None) -> DataFrame:
    """Adds struct `out` as classified() gives it; gates: which rules are tried, where the caller knows."""
    if gates is not None:
        return df.withColumn(out, classified(F.col(column), causes, gates))
    found, bits = prefilter(causes), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.col(column)))
    return df.withColumn(out, classified(F.col(column), causes, found.gates(F.col(bits)))).drop(bits)


def matched_rules(df: DataFrame, column: str, out: str = "matched_rules", causes: Sequence[rules.Cause] = tuple(rules.CAUSES)) -> DataFrame:
    """Adds array<string> `out` as in classify_rules' RESULT: for the names alone, matches are neither counted nor scored."""
    sure = [whole(x.pattern) for x in causes]  # found by their literals, these need no pattern
    found, bits = Prefilter([*prefilter(causes).sets, *sure]), f"__{out}_bits"
    df = df.withColumn(bits, found.column(F.col(column)))
    gates = found.gates(F.col(bits))
    tries = zip(causes, gates, gates[len(causes) :], strict=False)
    names = [F.when(has | (gate & regex.matches(F.col(column), c.pattern, "im")), F.lit(f"{c.category}/{c.subcategory}")) for c, gate, has in tries]
    return df.withColumn(out, F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))).drop(bits)


def cascade(rule: Column, ml: Column, settings: Settings = DEFAULTS) -> Column:
    """The cheapest answer that is sure enough: rules, then both, then the model.

    rule: as classify_rules gives it; ml: struct<category, confidence> or null.
    """
    def answer(category: Column, subcategory: Column, confidence: Column, source: str, matched: Column) -> Column:
        return F.struct(category.alias("category"), subcategory.alias("subcategory"), confidence.alias("confidence"), F.lit(source).alias("source"), matched.alias("matched_rules"))

    none, no_rules = F.lit(None).cast("string"), F.array().cast("array<string>")
    most = F.greatest(rule["confidence"], ml["confidence"])
    by_rules = answer(rule["category"], rule["subcategory"], rule["confidence"], "rules", rule["matched_rules"])
    by_model = answer(ml["category"], none, ml["confidence"], "ml", no_rules)
    agreed = answer(rule["category"], rule["subcategory"], F.least(F.lit(0.97), most + 0.10), "hybrid", rule["matched_rules"])
    unsure = answer(F.lit("UNKNOWN"), none, most, "llm", rule["matched_rules"])
    return (
        F.when((rule["confidence"] >= settings.rule_high) | ml.isNull(), by_rules)
        .when((ml["category"] == rule["category"]) & (rule["confidence"] > 0), agreed)
        .when(ml["confidence"] >= settings.rule_high, by_model)
        .when(most < settings.rule_low, unsure)
        .when(rule["confidence"] >= ml["confidence"], by_rules)
        .otherwise(by_model)
    )


def train_model(labelled: DataFrame, text: str = "text", label: str = "category", features: int = 1 << 16) -> PipelineModel:
    """A TF-IDF logistic regression; the model's size doesn't depend on the rows."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"),
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def classify_model(df: DataFrame, model: PipelineModel, out: str = "ml") -> DataFrame:
    """Adds struct `out`: category, confidence and the five likeliest, to four decimals."""
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    scored = PipelineModel(model.stages[1:]).transform(df).withColumn("__p", vector_to_array("probability"))
    pairs = F.arrays_zip(F.col("__p").alias("p"), names.alias("name"))
    ranked = F.reverse(F.array_sort(pairs))
    scored = scored.withColumn("__ranked", ranked)
    top = F.map_from_entries(F.transform(F.slice("__ranked", 1, 5), lambda x: F.struct(x["name"], F.round(x["p"], 4))))
    value = F.struct(F.get("__ranked", 0)["name"].alias("category"), F.get("__ranked", 0)["p"].alias("confidence"), top.alias("probabilities"))
    return scored.withColumn(out, value).select(*df.columns, out)


def load_model(path: str) -> PipelineModel | None:
    """The model at a path, or none: without a readable one the rules decide alone."""
    try:
        model = PipelineModel.load(path)
    except Exception:  # noqa: BLE001
        return None
    return model if hasattr(model.stages[0], "labels") else None


def classify(df: DataFrame, column: str, out: str = "classification", model: PipelineModel | None = None, text: str = "text", gates: Sequence[Column] | None = None) -> DataFrame:
    """Rules, with the model's help if there is one."""
    df = classify_rules(df, column, out, gates=gates)
    if model is None:
        return df
    scored = classify_model(df.withColumn(text, F.col(column)) if text != column else df, model, "__ml")
    return scored.withColumn(out, cascade(F.col(out), F.col("__ml"))).select(*df.columns)


def classifier_state(model: PipelineModel | None = None) -> dict:
    """How many rules there are, and whether a model helps them."""
    return {"rules": len(rules.CAUSES), "categories": rules.CATEGORIES, "model_loaded": model is not None}


def classifier_catalog(spark: SparkSession) -> DataFrame:
    """What the classifier knows: a row for each rule."""
    rows = [(i, c.category, c.subcategory, c.weight) for i, c in enumerate(rules.CAUSES)]
    return spark.createDataFrame(rows, "idx int, category string, subcategory string, weight double")
