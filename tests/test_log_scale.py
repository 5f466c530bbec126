"""What keeps the log queries' cost in proportion: rows dealt over tasks, and patterns tried where they can match."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_process_logs import ODD, SF, plain_logs_templates

from cinderlog import rules
from cinderlog.functions import regex
from cinderlog.functions.literals import Prefilter
from cinderlog.operators import classify, extract, redact, signature
from cinderlog.plans import queries


def test_logs_of_one_file_are_dealt_over_tasks(spark):
    dealt = queries.logs(spark, SF)
    assert dealt.rdd.getNumPartitions() >= 32
    assert dealt.count() == queries.table(spark, SF, "events").count()


def test_hits_are_those_without_gates(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD, *plain_logs_templates(), None]], "t string")
    gated = classify.hits(df, "t", "h").select("t", "h").collect()
    assert gated == df.select("t", classify.rule_hits(F.col("t")).alias("h")).collect()
    assert any(r.h for r in gated)


def test_rules_are_gated_in_the_queries(spark):
    for name in ("rule_hits", "category_scores"):
        assert "ArrowEvalPython" in queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


RUNS = [
    "PASSWORD_OF_A_SERVICE_WITH_NAME : hunter2", "x" * 31 + " y", "y" * 32, "z9+/" * 10, "token=abcd " + "q1W2e3R4" * 5, "a" * 30 + "_TOKEN: v", "sha256:" + "ab" * 32, "commit " + "0123456789" * 4, "id 123e4567-e89b-12d3-a456-426614174000 at 10.0.0.1:80",
    "　  at 0XAB, 1.2.3, /a/b/c.py:12 \x85", "container 3f2a9c1b7d4e 2024-01-01 10:00:00 5ms", "deadbeef1 12345 status 503 deadKeef",
]


def test_runs_gate_no_redaction_away(spark):
    """Long runs are found before redaction, also those that a replacement makes one longer."""
    df = spark.createDataFrame([(x,) for x in [*RUNS, *ODD, None]], "t string")
    name = "A" * 24 + "_TOKEN"
    df = df.union(spark.createDataFrame([(f"/{name} : v {name}1",)], df.schema))
    found = redact.prefilter(rules.REDACTIONS)
    gated = redact.redact(df, "t", "r").select("t", "r").collect()
    # every rule with literals keeps its gate, which is part of its meaning
    own = Prefilter([*(None if x.name == "aws_secret" else frozenset(x.literals) for x in rules.REDACTIONS), None], fold=False)
    want = df.withColumn("b", own.column(F.lower("t"))).select("t", redact.redacted(F.col("t"), own, F.col("b")).alias("r")).collect()
    assert gated == want
    assert found.sets[-1] is not None
    assert any("high_entropy" in (r.r.types or []) or "aws_secret" in (r.r.types or []) for r in gated)


def test_gates_change_no_normalised_text(spark):
    df = spark.createDataFrame([(x,) for x in [*RUNS, *ODD, *plain_logs_templates()]], "t string")
    found = signature.prefilter()
    got = df.withColumn("b", found.column(F.col("t"))).select("t", signature.normalised(F.col("t"), gates=found.gates(F.col("b"))).alias("n")).collect()
    assert got == df.select("t", signature.normalised(F.col("t")).alias("n")).collect()
    assert all(any(token in r.n for r in got) for token in ("<sha>", "<digest>", "<uuid>", "<container_id>", "<hex>", "<timestamp>", "<ip>", "<version>"))


def test_strip_takes_every_space_the_pattern_takes(spark):
    points = [*range(1, 0x3001), 0xFEFF]
    df = spark.createDataFrame([(p, chr(p) + "a" + chr(p) + "b" + chr(p)) for p in points if not 0xD800 <= p < 0xE000], "p int, t string")
    by_pattern = regex.replace(regex.replace(F.col("t"), r"\A\s+", ""), r"\s+\z", "")
    assert df.where(regex.strip(F.col("t")) != by_pattern).count() == 0


def test_families_are_those_without_gates(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD, *plain_logs_templates(), None]], "cleaned string")
    assert extract.families(df).select("cleaned", "family").collect() == df.select("cleaned", extract.family(F.col("cleaned")).alias("family")).collect()
    assert "ArrowEvalPython" in queries.error_family(spark, SF)._jdf.queryExecution().executedPlan().toString()
