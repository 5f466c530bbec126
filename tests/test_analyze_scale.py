"""What keeps an analysis' fixed cost low: few passes through Python, and tables made side by side."""

from __future__ import annotations

import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinderlog.functions import regex
from cinderlog.operators import classify, redact
from cinderlog.plans import pipeline, queries

SF = "/root/testdata/sf0.001"
SIGNATURES = "team_id long, hash string, category string, subcategory string, occurrence_count long, is_known boolean, known_root_cause string, known_resolution string"


def test_a_request_is_scanned_in_one_pass(spark):
    requests = queries.requests(spark, SF)
    passes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    causes = classify.prefilter()
    done = redact.redact_request(requests, more={"b": (causes, F.coalesce(regex.nonempty(F.col("error_block")), F.col("log_excerpt")))})
    assert passes(done) == passes(requests) + 1


def test_what_redaction_makes_is_classified(spark):
    """Rules see the redacted text, also literals that only redaction makes: as by all rules, tried without gates."""
    secrets = [f"{x.upper()}_TOKEN=Ab3dE6gH{i}kLmN0pQ" for i, x in enumerate(("api", "deploy", "x509"))] + ["https://u:Zq81hunter2Xv@host/a", "mail a.b@corp.io", "Authorization: Bearer abcDEF123456ghiJKL789"]
    requests = queries.requests(spark, SF).limit(160).withColumn("error_block", F.concat_ws("\n", F.get(F.array(*map(F.lit, secrets)), (F.col("request_id") % len(secrets)).cast("int")), F.col("error_block")))
    requests = requests.withColumn("error_block", F.when(F.col("request_id") % 5 > 0, F.col("error_block"))).cache()
    for whole in (True, False):
        basis = F.coalesce(regex.nonempty(F.col("error_block")), F.col("log_excerpt"))
        want = redact.redact_request(requests, redact_all=whole).select("request_id", classify.classified(basis).alias("c"))
        found = pipeline.analyze(requests.withColumn("use_llm", F.lit(False)), spark.createDataFrame([], SIGNATURES), redact_all=whole)
        got = {r.request_id: (r.category, r.confidence) for r in found.select("request_id", "analysis.category", "analysis.confidence").collect()}
        assert got == {r.request_id: (r.c.category, r.c.confidence) for r in want.collect()}
        assert len(got) == 160 and len({x for x, _ in got.values()}) > 5


def test_tables_are_made_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)
    a, b = pipeline.started(spark, lambda: (both.wait(), spark.range(3).count())[1], lambda: (both.wait(), spark.range(4).count())[1])
    assert (a.result(), b.result()) == (3, 4)
    (broken,) = pipeline.started(spark, lambda: spark.range(1).select("nothing"))
    with pytest.raises(PySparkException):
        broken.result()
