"""What analyze stores, admits, asks and reports."""

from __future__ import annotations

import glob
import json
import os
import random
import sys
import tempfile
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cinderlog.operators import answers, chunk, ledger, providers
from cinderlog.plans import pipeline, queries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder
SF = "/root/testdata/sf0.001"
SIGNATURES = "team_id long, hash string, category string, subcategory string, occurrence_count long, is_known boolean, known_root_cause string, known_resolution string"


@pytest.fixture
def shared(spark):
    """The intermediate tables that the test makes: a function that lists their folders."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/cinderlog-work").removeprefix("file:")
    before = set(glob.glob(f"{base}/cinderlog-*"))
    return lambda: sorted(set(glob.glob(f"{base}/cinderlog-*")) - before)


class Fixed:
    """Answers after what its settings say; every question leaves a line in a file."""

    name = "fixed"

    def __init__(self, override, folder=None):
        self.settings, self.folder = json.loads(override or "{}"), folder

    def ask(self, prompt):
        if self.folder:
            with open(f"{self.folder}/asked-{os.getpid()}-{threading.get_ident()}", "a") as f:
                f.write(prompt[:40].replace("\n", " ") + "\n")
        if self.settings.get("fails"):
            raise providers.ProviderError(self.settings["fails"], "no answer")
        return providers.Reply('{"category": "TEST", "severity": "low", "confidence": "0.9", "summary": "s", "root_cause": "r"}', "m", self.name, 1000, 100)

    def cost(self, tokens_in, tokens_out):
        return (tokens_in + tokens_out) * 1e-6


def written(folder):
    """Every value of every file under a folder, as text."""
    out = []
    for path in glob.glob(f"{folder}/**/*", recursive=True):
        if path.endswith(".parquet"):
            out.append(json.dumps(pq.read_table(path).to_pylist(), default=str))
        elif os.path.isfile(path):
            with open(path, "rb") as f:
                out.append(f.read().decode("utf-8", "replace"))
    return "\n".join(out)


def test_no_secret_is_stored(spark, shared, tmp_path):
    """Secrets planted in each text of a request, and a key in its settings: none is in any file."""
    secret = {k: f"{k}Hunter2Zq{i}Xv9LmT4" for i, k in enumerate(("excerpt", "block", "trace", "patch", "window", "message", "override"))}
    plant = lambda c, k: F.concat(c, F.lit(f"\nDB_PASSWORD={secret[k]}\n"))
    files = F.transform(F.col("pipeline.changed_files"), lambda x: x.withField("patch", plant(x["patch"], "patch")))
    window = F.array(F.struct(F.lit("a.py").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), plant(F.lit("x"), "window").alias("content")))
    requests = queries.requests(spark, SF).where("use_llm").limit(20).withColumns({
        "log_excerpt": plant(F.col("log_excerpt"), "excerpt"), "error_block": plant(F.coalesce("error_block", F.lit("ERROR x")), "block"), "stack_trace": plant(F.coalesce("stack_trace", F.lit("t")), "trace"),
        "pipeline": F.col("pipeline").withField("changed_files", files).withField("commit_message", plant(F.lit("m"), "message")), "source_context": window,
        "llm_override": F.to_json(F.struct(F.lit(secret["override"]).alias("api_key"), F.when(F.col("request_id") % 2 == 0, "auth").alias("fails"))),
    })
    requests.write.parquet(f"{tmp_path}/requests")
    log = answers.AnswerLog(f"file://{tmp_path}/log")
    chunks = spark.createDataFrame([], "document_id long, chunk_index int, team_id long, content string, embedding array<float>")
    documents = spark.createDataFrame([], "id long, title string, project_id long, is_active boolean")
    found = pipeline.analyze(spark.read.parquet(f"{tmp_path}/requests"), spark.createDataFrame([], SIGNATURES), sources=pipeline.Sources(None, chunks, documents), make_provider=lambda o: Fixed(o), answer_log=log)
    found.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    tables = "\n".join(written(x) for x in shared())
    everything = tables + written(tmp_path / "log") + written(tmp_path / "out")
    assert "DB_PASSWORD=[REDACTED]" in tables and len(shared()) >= 3
    assert [k for k, v in secret.items() if v in everything] == []
    assert all(v in written(tmp_path / "requests") for v in secret.values())


def test_errors_say_what_they_are(spark, shared):
    kinds = ["auth", "rate_limit", "timeout", "unavailable", "invalid", None]
    pick = F.get(F.array(*(F.lit(k) for k in kinds)), (F.col("request_id") % 6).cast("int"))
    requests = queries.requests(spark, SF).where("use_llm").limit(30).withColumn("llm_override", F.to_json(F.struct(pick.alias("fails"))))
    want = {"auth": ("AI_PROVIDER_UNAUTHORIZED", 401, False), "rate_limit": ("AI_PROVIDER_RATE_LIMITED", 429, True), "timeout": ("AI_PROVIDER_TIMEOUT", 504, True), "unavailable": ("AI_PROVIDER_ERROR", 503, True), "invalid": ("AI_INVALID_RESPONSE", 502, True)}
    rows = pipeline.analyze(requests, spark.createDataFrame([], SIGNATURES), make_provider=lambda o: Fixed(o)).collect()
    assert len(rows) == 30
    for r in rows:
        kind = kinds[r.request_id % 6]
        assert r.status == ("model" if kind is None else "provider_error") and not r.degraded
        assert r.error is None if kind is None else (r.error.kind, r.error.code, r.error.status, r.error.retryable, r.error.message) == (kind, *want[kind], "no answer")


def test_retrieval_fails_for_one_request_alone(spark, shared):
    """The encoder fails on some texts, or can't be made: those analyses go on without retrieval, and say so."""

    class Picky(chunk.HashedEncoder):
        def __call__(self, texts):
            if any("heap" in x for x in texts):
                raise ValueError("no")
            return super().__call__(texts)

    def none():
        raise OSError("no model here")

    requests = queries.requests(spark, SF).where("use_llm").limit(40).cache()
    documents = spark.createDataFrame([(1, "t", None, True)], "id long, title string, project_id long, is_active boolean")
    vector = [float(x) for x in chunk.HashedEncoder()(["UNKNOWN x"])[0]]
    chunks = spark.createDataFrame([(1, 0, t, "c", vector) for t in range(5)], "document_id long, chunk_index int, team_id long, content string, embedding array<float>")
    heap = {r.request_id for r in requests.where("contains(coalesce(error_block, log_excerpt), 'heap')").collect()}
    assert 0 < len(heap) < 40
    for encoder, want in ((Picky, heap), (none, {r.request_id for r in requests.collect()})):
        found = pipeline.analyze(requests, spark.createDataFrame([], SIGNATURES), sources=pipeline.Sources(None, chunks, documents, encoder))
        rows = found.collect()
        assert len(rows) == 40 and {r.request_id for r in rows if r.degraded} == want
    with pytest.raises(Exception, match="no"):
        chunk.embed(spark.createDataFrame([("heap",)], "t string"), "t", encoder=Picky).collect()


def sequential(requests, budgets):
    running, out = {}, {}
    for i, team, cost in sorted(requests):
        budget, spent = budgets.get(team, (None, 0))
        before = running.setdefault(team, spent)
        out[i] = not budget or before < budget
        if out[i]:
            running[team] = before + max(cost or 0, 0)
    return out


def test_admission_equals_a_sequential_loop(spark, shared):
    """10,000 requests; team 0 has nine tenths of them, so its running cost goes over several ranges."""
    rng = random.Random(6)
    requests = [(i, 0 if rng.random() < 0.9 else rng.randrange(1, 7), rng.choice([0, 1, 2, 5, None]) if rng.random() < 0.9 else 20) for i in range(10_000)]
    budgets = {0: (9000, 100), 1: (300, 299), 2: (50, 50), 3: (None, 10), 4: (0, 10), 5: (10**6, 0)}
    df = spark.createDataFrame(requests, "request_id long, team_id long, cost_usd long").repartition(7)
    limits = spark.createDataFrame([(t, None if b is None else float(b), float(s)) for t, (b, s) in budgets.items()], "team_id long, budget double, spent double")
    found = ledger.admitted(df, limits, ["request_id"])
    rows = found.collect()
    want = sequential(requests, budgets)
    assert {r.request_id: r.admitted for r in rows} == want and len(rows) == 10_000
    assert 0 < sum(want[i] for i, t, _ in requests if t == 0) < sum(t == 0 for _, t, _ in requests)
    assert ledger.admitted(df.limit(0), limits, ["request_id"]).count() == 0


def test_analysis_stops_where_the_budget_ends(spark, shared):
    requests = queries.requests(spark, SF).where("use_llm").limit(60).cache()
    teams = spark.createDataFrame([(t, 1.0 if t < 4 else None) for t in range(5)], "id long, monthly_ai_budget_usd double")
    spent = spark.createDataFrame([(0, 0.5, "success", "2024-01-05 00:00:00")], "team_id long, cost_usd double, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    as_of = F.lit("2024-01-20").cast("timestamp")
    rows = pipeline.analyze(requests, spark.createDataFrame([], SIGNATURES), teams, spent, as_of, rates=(0.0, 1.0)).collect()
    # 180 expected tokens are 18 cents: team 0 has room for 3 requests, teams 1 to 3 for 6
    for t in range(5):
        own = [r for r in sorted(rows, key=lambda r: r.request_id) if r.request_id in {x.request_id for x in requests.where(F.col("team_id") == t).collect()}]
        room = {0: 3, 4: len(own)}.get(t, 6)
        assert [r.status for r in own] == ["model"] * min(room, len(own)) + ["budget_exceeded"] * (len(own) - room)
        assert all(r.error.code == "AI_BUDGET_EXCEEDED" and r.error.status == 402 and not r.error.retryable for r in own[room:])


def test_a_killed_task_asks_each_prompt_once(spark, shared, tmp_path):
    """Tasks die midway at their first attempt; the second one takes up what was written."""
    log, folder = answers.AnswerLog(f"{tmp_path}/log", buckets=8), tmp_path / "asked"
    folder.mkdir()

    class Deadly(Fixed):
        def ask(self, prompt):
            n = len(glob.glob(f"{folder}/asked-*"))
            done = sum(len(open(x).readlines()) for x in glob.glob(f"{folder}/asked-*"))
            if n and done == 13 and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)  # the worker is gone, and with it all that wasn't written
            return super().ask(prompt)

    df = spark.createDataFrame([(i, f"prompt {i % 50:02d}") for i in range(80)], "id long, p string").coalesce(1)
    answered = answers.complete(df, "p", lambda o: Deadly(o, str(folder)), log=log)
    with pytest.raises(Exception, match="crashed"):
        answered.collect()
    time.sleep(2)
    assert os.path.exists(f"{folder}/died")
    rows = answers.complete(df, "p", lambda o: Deadly(o, str(folder)), log=log).collect()  # local mode doesn't run a task again, so the job is
    assert os.path.exists(f"{folder}/died")
    assert len(rows) == 80 and all(r.reply.error_kind is None for r in rows)
    lines = [x for f in glob.glob(f"{folder}/asked-*") for x in open(f)]
    assert sorted(lines) == sorted(f"prompt {i:02d}\n" for i in range(50))
    assert answers.complete(df, "p", lambda o: Fixed(o, str(folder)), log=log).count() == 80
    assert len([x for f in glob.glob(f"{folder}/asked-*") for x in open(f)]) == 50


def test_failures_and_torn_lines_are_asked_again(tmp_path):
    log = answers.AnswerLog(str(tmp_path), buckets=1)
    replies = iter([(None, "p", "m", 0, 0, 0.0, None, "timeout", "x"), ("text", "p", "m", 1, 1, 0.0, None, None, None)])
    rows = [(0, "k", "prompt", None)]
    assert next(answers.asked(rows, log, lambda o, p: next(replies), answers.Pace()))[1][7] == "timeout"
    assert list(answers.asked(rows, log, lambda o, p: next(replies), answers.Pace())) == [("k", ("text", "p", "m", 1, 1, 0.0, None, None, None))]
    path = glob.glob(f"{tmp_path}/**/*.jsonl", recursive=True)
    assert len(path) == 1
    with open(path[0], "r+b") as f:
        f.truncate(os.path.getsize(path[0]) - 9)
    assert list(answers.asked(rows, log, lambda o, p: ("again",) + (None,) * 8, answers.Pace()))[0][1][0] == "again"


def test_concurrency_and_pace_are_bounded():
    open_, most, lock = 0, 0, threading.Lock()

    def ask(override, prompt):
        nonlocal open_, most
        with lock:
            open_ += 1
            most = max(most, open_)
        time.sleep(0.01)
        with lock:
            open_ -= 1
        return ("t",) + (None,) * 8

    rows = [(i // 10, str(i), "p", None) for i in range(40)]
    assert [k for k, _ in answers.asked(rows, None, ask, answers.Pace(4))] == [str(i) for i in range(40)]
    assert most == 4
    now, slept = [0.0], []
    bucket = answers.TokenBucket(2.0, 3, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(7):
        bucket.take()
    assert slept == [0.5] * 4  # a burst of three, then two a second
