"""Chunks, retrieval, ledger, recommendations, prompts, providers, sources and streams."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import analyze, chunk, ledger, prompt, providers, recommend, retrieve
from cinderlog.plans import pipeline, queries
from cinderlog.sources import io
from cinderlog.streaming import logs as streams

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def reference_chunks(text, target, overlap):
    """An independent packing, by characters."""
    out, cur = [], ""
    for p in (q.strip() for q in __import__("re").split(r"\n\s*\n", text.strip())):
        if not p:
            continue
        if len(p) > target:
            out += [cur] if cur else []
            cur = ""
            out += [p[i : i + target] for i in range(0, len(p), max(1, target - overlap))]
        elif cur and len(cur) + 2 + len(p) > target:
            out.append(cur)
            tail = cur if len(cur) <= overlap or not overlap else cur[-overlap:]
            if overlap and len(cur) > overlap and " " in tail:
                tail = tail[tail.index(" ") + 1 :]
            cur = tail + "\n\n" + p if overlap else p
        else:
            cur = cur + "\n\n" + p if cur else p
    return [c.strip() for c in [*out, *([cur] if cur else [])] if c.strip()]


@pytest.mark.parametrize(("target", "overlap"), [(30, 5), (10, 0), (150, 25)])
def test_chunks(spark, target, overlap):
    texts = ["", "  \n\n ", "a b c", "word " * 300, "\n\n".join(f"paragraph {i} " + "x" * (i * 7 % 90) for i in range(30)), "a\n\n" + "y" * 500 + "\n\nb"]
    for text in texts:
        got = one(spark, chunk.chunks(F.lit(text), target, overlap))
        assert [c.content for c in got] == reference_chunks(text, target * 4, overlap * 4)
        assert [c["index"] for c in got] == list(range(len(got)))


def test_paragraphs_of_the_queries(spark):
    """Every second newline is doubled, and texts keep all else."""
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None] + ["", "a", "a\nb", "a\nb\nc", "\n\n\n", "a\n\nb\n"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", queries._doubled(F.col("t")).alias("d")).collect()
    assert {r.i: r.d for r in found} == {i: re.sub(r"([^\n]*\n[^\n]*)\n", "\\1\n\n", x) for i, x in enumerate(rows)}


def test_embedding_input(spark):
    text = chunk.embedding_input(F.lit(" boom "), F.lit("UNKNOWN"), F.lit(""), F.lit("unit"))
    assert one(spark, text) == "boom | job: unit"
    rows = chunk.chunk_embed(spark.createDataFrame([(1, "T", "x y"), (2, None, "")], "id long, title string, text string"), "text", "title", ["id"]).collect()
    assert [(r.id, r.content, len(r.embedding)) for r in rows] == [(1, "x y", 384)]


def test_neighbours(spark):
    seeds = spark.createDataFrame([(1, 1, 10, 1, 0.9), (1, 2, 20, 0, 0.8), (1, 3, 10, 5, 0.7)], "query_id int, rank int, document_id long, chunk_index int, similarity double")
    chunks = spark.createDataFrame([(d, i, f"{d}/{i}") for d in (10, 20, 30) for i in range(8)], "document_id long, chunk_index int, content string")
    documents = spark.createDataFrame([(10, "a", True), (20, "b", True), (30, "c", True)], "id long, title string, is_active boolean")
    rows = retrieve.expand_neighbours(seeds, chunks, documents).orderBy("position").collect()
    assert [(r.document_id, r.chunk_index) for r in rows] == [(10, 0), (10, 1), (10, 2), (10, 3), (10, 4), (10, 5)]
    assert {r.similarity for r in rows} == {0.7}  # the document's last seed
    assert retrieve.expand_neighbours(seeds.limit(0), chunks, documents).count() == 0


def test_null_order_of_categories(spark):
    rows = [(i, 1, [1.0, 0.0], c, "m", None, None, None, "p", None) for i, c in enumerate(["A", None, "B"])]
    corpus = spark.createDataFrame(rows, "failure_id long, team_id long, embedding array<float>, category string, error_message string, failed_at timestamp, resolved_at timestamp, resolution_note string, project_name string, known_resolution string")
    assert [r.failure_id for r in retrieve.similar_failures(corpus, [1.0, 0.0], 1, "A").collect()] == [1, 0, 2]
    assert [r.failure_id for r in retrieve.similar_failures(corpus, [1.0, 0.0], 1, "A", null_order="documented").collect()] == [0, 2, 1]
    assert retrieve.similar_failures(corpus, [0.0, 0.0], 1).count() == 0
    assert retrieve.similar_failures(corpus, [1.0, 0.0], 1, exclude=0, limit=0).count() == 2


def test_failed_lookups_leave_nothing(spark):
    empty = spark.range(0)
    assert retrieve.safely(lambda: spark.range(1).select("no_such"), empty) == (empty, False)
    assert retrieve.safely(lambda: spark.range(1), empty)[1]


def test_budget(spark):
    teams = spark.createDataFrame([(1, 10.0), (2, 0.0), (3, None), (4, 10.0), (5, 10.0)], "id long, monthly_ai_budget_usd double")
    rows = [(1, 8.0, "success", "2024-01-05"), (4, 10.0, "success", "2024-01-01"), (5, 50.0, "success", "2023-12-31"), (5, 50.0, "error", "2024-01-05")]
    ai = spark.createDataFrame(rows, "team_id long, cost_usd double, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    got = {r.team_id: r.status for r in ledger.budget_status(teams, ai, F.lit("2024-01-20").cast("timestamp")).collect()}
    assert got == {1: "warning", 2: "unlimited", 3: "unlimited", 4: "exceeded", 5: "ok"}


PATCH = "--- a/src/x.py\n+++ b/src/x.py\n@@ -1 +1 @@\n-a\n+b\n"


def item(action, patch=None, confidence="0.4"):
    none = F.lit(None).cast("string")
    return F.struct(F.lit("t").alias("title"), none.alias("description"), none.alias("rationale"), F.lit(action).alias("action_type"), F.lit(confidence).alias("confidence"), F.lit(None).cast("array<string>").alias("affected_files"), F.lit(patch).cast("string").alias("patch"))


def test_recommendations(spark):
    items = F.array(item("edit_file", PATCH), item("update_config", PATCH), item("nonsense"), item("rollback_deployment"), item("investigate", None, "7"), item("manual"))
    got = one(spark, recommend.sanitised(items, F.lit(False), F.array(F.lit("src/x.py"))))
    assert [(r.action_type, r.risk) for r in got] == [("create_merge_request", "medium"), ("create_merge_request", "high"), ("manual", "medium"), ("rollback_deployment", "critical"), ("investigate", "low")]
    assert got[4].confidence == 1.0
    assert got[0].affected_files == []
    raised = one(spark, recommend.sanitised(items, F.lit(True), F.array(F.lit("src/x.py"))))
    assert [r.risk for r in raised] == ["high", "critical", "high", "critical", "low"]


@pytest.mark.parametrize(
    ("patch", "known", "good"),
    [(PATCH, ["src/x.py"], True), (PATCH, ["./src/x.py"], True), (PATCH, ["x.py"], True), (PATCH, ["repo/src/x.py"], True), (PATCH, ["y.py"], False), (PATCH, None, True), (" ", None, False), (PATCH.replace("@@ -1 +1 @@", ""), None, False), (PATCH + "x" * 8000, None, False), ("@@ -1 +1 @@", None, False)],
)
def test_patches(spark, patch, known, good):
    files = F.lit(None).cast("array<string>") if known is None else F.array(*(F.lit(x) for x in known))
    assert (one(spark, recommend.valid_patch(F.lit(patch), files)) is not None) == good


@pytest.mark.parametrize(
    ("raw", "source", "rule", "category", "known", "retrieved", "used", "want"),
    [("0.9", "hybrid", 0.9, "TEST", False, False, False, 0.95), ("0.96", "hybrid", 0.9, "TEST", False, False, False, 0.97), ("0.9", "rules", 0.9, "TEST", True, True, True, 0.98), ("0.95", "rules", 0.9, "TEST", False, True, False, 0.85), ("0.95", "rules", 0.9, "UNKNOWN", False, False, False, 0.7), ("x", "rules", 0.9, "TEST", None, False, False, 0.5), (None, "rules", 0.9, "TEST", None, False, False, 0.5), ("-3", "rules", 0.9, "TEST", None, False, False, 0.0)],
)
def test_calibration(spark, raw, source, rule, category, known, retrieved, used, want):
    got = analyze.calibrated(F.lit(raw).cast("string"), F.lit(source), F.lit(rule), F.lit(category), F.lit(known).cast("boolean"), F.lit(retrieved), F.lit(used))
    assert one(spark, got) == pytest.approx(want)


def test_salvage_and_errors(spark):
    texts = {'x\n```json\n{"category": "A"}\n```': "A", 'so {"category": "B"} end': "B", '{"category": "C"}': "C", "none": None, "[1, 2]": None, "```{broken```": None}
    for text, want in texts.items():
        got = one(spark, providers.salvage(F.lit(text)))
        assert (got and got.category) == want
    kinds = {"401 from quota": "auth", "GenerateContent: socket": "unavailable", "rate limit": "rate_limit", "Deadline": "timeout"}
    for message, kind in kinds.items():
        assert one(spark, providers.error_kind(F.lit(message))).kind == kind


def fixed(*args):
    """A provider with one answer or failure; its class is local, so workers needn't import this file."""

    class Fixed:
        def __init__(self, name, fails=None, price=0.0):
            self.name, self.fails, self.price = name, fails, price

        def ask(self, prompt):
            if self.fails:
                raise providers.ProviderError(self.fails)
            return providers.Reply('{"category": "TEST", "summary": "s", "confidence": 0.6}', "m", self.name, 1000, 100)

        def cost(self, a, b):
            return (a + b) * self.price

    return Fixed(*args)


def test_fallback_provider():
    assert providers.FallbackProvider(fixed("a"), fixed("b")).ask("x").fell_back_from is None
    for kind in providers.RETRYABLE:
        p = providers.FallbackProvider(fixed("a", kind, 2.0), fixed("b"))
        r = p.ask("x")
        assert (r.provider, r.fell_back_from, p.cost(1, 1)) == ("b", "a", 4.0)
    for kind in ("auth", "invalid"):
        with pytest.raises(providers.ProviderError):
            providers.FallbackProvider(fixed("a", kind), fixed("b")).ask("x")


def test_provider_settings():
    env = {"LLM_PROVIDER": "gemini", "GEMINI_API_KEY": "env", "GEMINI_MODEL": "g"}
    assert providers.spec_of(None).kind == "stub"
    assert (providers.spec_of(None, env).kind, providers.spec_of(None, env).api_key) == ("gemini", "env")
    own = providers.spec_of('{"provider": "azure_openai", "api_key": "k", "model": "m", "input_cost_per_1k": 0.5, "fallback": {"provider": "ollama"}}', env)
    assert (own.kind, own.api_key, own.model, own.input_cost_per_1k, own.fallback.kind) == ("openai", "k", "m", 0.5, "ollama")
    assert providers.spec_of({"provider": "gemini"}, env, allow_environment=False).api_key == ""
    for bad in ('{"provider": "none"}', "no json", "[1]"):
        with pytest.raises(providers.ProviderError):
            providers.spec_of(bad)
    with pytest.raises(providers.ProviderError):
        providers.spec_of(None, allow_stub=False)


def test_http_providers():
    """Requests, answers, repeated attempts and prices, with a transport of our own."""
    sent, waits = [], []
    answers = {
        "gemini": {"candidates": [{"content": {"parts": [{"text": '{"category": "TEST"}'}]}}], "usageMetadata": {"promptTokenCount": 2000, "candidatesTokenCount": 100, "thoughtsTokenCount": 400}},
        "openai": {"choices": [{"message": {"content": '{"category": "TEST"}'}}], "usage": {"prompt_tokens": 2000, "completion_tokens": 500}},
        "ollama": {"response": '{"category": "TEST"}', "prompt_eval_count": 2000, "eval_count": 500},
    }
    for kind, answer in answers.items():
        def send(url, headers, body, seconds, answer=answer):  # noqa: ANN001, ANN202
            sent.append((url, headers, body))
            return answer

        p = providers.HttpProvider(providers.Spec(kind, "m", "k", "http://h/", 0.1, 0.2), send)
        r = p.ask("why?")
        assert (r.text, r.prompt_tokens, r.completion_tokens, p.cost(r.prompt_tokens, r.completion_tokens)) == ('{"category": "TEST"}', 2000, 500, 0.3)
    assert [x[0] for x in sent] == ["http://h/models/m:generateContent", "http://h/chat/completions", "http://h/api/generate"]
    assert sent[0][1] == {"x-goog-api-key": "k"}
    assert sent[1][1] == {"Authorization": "Bearer k"}
    assert sent[1][2]["response_format"]["json_schema"]["schema"]["required"] == ["category", "severity", "confidence", "summary", "root_cause"]
    for message, kind, tries in (("429 too many", "rate_limit", 3), ("deadline exceeded", "timeout", 3), ("401 unauthorized", "auth", 1), ("500 oops", "unavailable", 1)):
        calls = []

        def fail(*_, message=message, calls=calls):  # noqa: ANN002, ANN202
            calls.append(1)
            raise OSError(message)

        with pytest.raises(providers.ProviderError) as e:
            providers.HttpProvider(providers.Spec("openai", "m"), fail, waits.append).ask("x")
        assert (e.value.kind, len(calls)) == (kind, tries)
    assert waits == [2.0, 4.0, 2.0, 4.0]
    with pytest.raises(providers.ProviderError) as e:
        providers.HttpProvider(providers.Spec("ollama", "m"), lambda *_: {"response": "sorry"}).ask("x")
    assert e.value.kind == "invalid"


def test_verify_records(spark):
    def send(url, headers, body, seconds):  # noqa: ANN001, ANN202
        if "bad" in url:
            raise OSError("401 unauthorized")
        return {"models": [{"name": "m"}]} if body is None else {"response": "{}"}

    good, bad = providers.Spec("ollama", "m", base_url="http://good"), providers.Spec("openai", "m", base_url="http://bad")
    assert providers.verify(good, send)["ok"]
    assert not providers.verify(bad, send)["ok"]
    assert "has no model" in providers.verify(providers.Spec("ollama", "x", base_url="http://good"), send)["message"]
    both = providers.verify(providers.Spec("openai", "m", base_url="http://bad", fallback=good), send)
    assert both["ok"]
    assert both["provider"] == "openai -> ollama"
    rows = providers.verify_rows(spark.createDataFrame([("{}",), ('{"provider": "x"}',)], "o string"), "o").select("check.*").collect()
    assert [r.ok for r in rows] == [True, False]


def test_analysis_with_providers_and_retrieval(spark):
    requests = queries.requests(spark, SF).where("use_llm").limit(30)
    override = F.when(F.col("request_id") % 3 == 0, "fails").when(F.col("request_id") % 3 == 1, "breaks")
    requests = requests.withColumn("llm_override", override).cache()
    signatures = spark.createDataFrame([], "team_id long, hash string, category string, subcategory string, occurrence_count long, is_known boolean, known_root_cause string, known_resolution string")

    class Broken:
        name = "x"

        def ask(self, prompt):
            raise RuntimeError("Deadline Exceeded")

    made = {"fails": fixed("a", "auth"), None: fixed("a", None, 1e-6), "breaks": Broken()}

    found = {r.request_id: r for r in pipeline.analyze(requests, signatures, make_provider=made.get).collect()}
    assert len(found) == 30
    for i, r in found.items():
        assert r.status == ("provider_error" if i % 3 < 2 else "model")
        if i % 3 == 2:
            assert abs(r.analysis.usage.cost_usd - 0.0011) < 1e-9
            assert r.analysis.summary == "s"
        assert not r.analysis.used_rag
    one = requests.select("team_id", "project.id", "error_block").where("error_block IS NOT NULL").first()
    encode = chunk.HashedEncoder()
    vector = [float(x) for x in encode([one.error_block])[0]]
    documents = spark.createDataFrame([(1, "runbook", None, True)], "id long, title string, project_id long, is_active boolean")
    parts = spark.createDataFrame([(1, i, t, "how to fix it %d" % i, vector if i == 1 else [0.0] * 384) for i in range(5) for t in [one.team_id]], "document_id long, chunk_index int, team_id long, content string, embedding array<float>")
    context = pipeline.retrieved(
        requests.where(F.col("error_block") == one.error_block).where(F.col("team_id") == one.team_id).select("request_id", "team_id", F.col("project.id").alias("project_id"), F.lit("").alias("category"), F.col("error_block").alias("error_message"), F.lit(None).cast("string").alias("ecosystem"), F.lit(None).cast("string").alias("job_name")),
        pipeline.Sources(None, parts, documents),
    ).collect()
    assert context
    assert all([x.content for x in r.knowledge] == ["how to fix it %d" % i for i in range(4)] for r in context)
    used = pipeline.analyze(requests, signatures, sources=pipeline.Sources(None, parts, documents)).where("analysis.used_rag").count()
    assert used >= 1
    broken = pipeline.Sources(None, spark.range(1), documents)  # retrieval that can't be planned degrades
    assert pipeline.analyze(requests, signatures, sources=broken).where("analysis.used_rag").count() == 0


def test_analysis_branches(spark):
    requests = queries.requests(spark, SF).limit(40).cache()
    signatures = spark.createDataFrame([(r, "h0", "NETWORK", None, 3, True, "dns", "restart dns") for r in range(5)], "team_id long, hash string, category string, subcategory string, occurrence_count long, is_known boolean, known_root_cause string, known_resolution string")
    rows = {r.request_id: r for r in pipeline.analyze(requests, signatures).collect()}
    assert len(rows) == 40
    statuses = {r.status for r in rows.values()}
    assert {"rules", "model"} <= statuses
    for r in rows.values():
        if r.status == "known_signature":
            assert r.analysis.confidence == 0.95
            assert r.analysis.usage.cache_hit
        if r.status == "model":
            assert r.analysis.summary.startswith("[stub]")
            assert r.analysis.evidence


def test_prompt_sections(spark):
    df = queries.requests(spark, SF).limit(1).select(F.struct("*").alias("r"))
    c = F.struct(F.lit("TEST").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit(0.5).alias("confidence"), F.lit("rules").alias("source"), F.array().cast("array<string>").alias("matched_rules"))
    text = df.withColumn("c", c).select(prompt.render("r", "c", F.lit("l1\nl2")).alias("p")).first().p
    assert "# Log\nlines 1-2 of 2" in text
    assert "# Changed files\nsrc/app.py" in text
    assert "3.0 times as long" in text
    assert "# Source" not in text
    assert "# Known" not in text


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    assert [r.raw_log for r in io.read_log_files(spark, str(tmp_path / "*.log")).collect()] == ["one\ntwo"]
    (tmp_path / "r.json").write_text(json.dumps({"team_id": 3, "use_llm": True, "extra": 1}) + "\n")
    assert io.read_requests(spark, str(tmp_path / "r.json")).first().team_id == 3
    (tmp_path / "bad.json").write_text('{"team_id": "three"}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        io.read_requests(spark, str(tmp_path / "bad.json")).collect()
    assert io.export_contracts(str(tmp_path / "c"))
    assert io.export_contracts(str(tmp_path / "c")) == []
    target = spark.createDataFrame([(1, 1, 1, [1.0], "m", 1, "s", None)], "failure_id long, signature_id long, team_id long, embedding array<float>, model string, dimensions int, source_text string, created_at timestamp")
    target.write.partitionBy("team_id").parquet(str(tmp_path / "e"))
    new = io.write_embeddings(spark, str(tmp_path / "e"), target.withColumns({"embedding": F.array(F.lit(2.0).cast("float")), "signature_id": F.lit(9).cast("long")}).select(*spark.read.parquet(str(tmp_path / "e")).columns))
    r = spark.read.parquet(new).first()
    assert (r.embedding, r.signature_id) == ([2.0], 1)
    assert io.is_alive(spark)
    assert pipeline.service_info()["rules"] == 36


def test_stream_equals_table(spark, tmp_path):
    rows = queries.logs(spark, SF).select("log_id", "team_id", "ts", "raw_log").limit(50)
    rows.write.parquet(str(tmp_path / "in"))
    batch = {(r.log_id, r.signature_hash) for r in pipeline.process_logs(spark.read.parquet(str(tmp_path / "in"))).select("log_id", "signature_hash").collect()}
    stream = streams.process_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.select("log_id", "signature_hash").writeStream.format("memory").queryName("signed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("signed").collect()} == batch
    counted = streams.signature_windows(stream.select("ts", "team_id", "signature_hash"))
    q = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("occurrence_count")).first()[0] == 50
