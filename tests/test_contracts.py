from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cinderlog.plans import queries
from cinderlog.sources import contracts, io, schemas

ANALYZE = contracts.CONTRACTS["analyze_requests"]
GOOD = {
    "team_id": 3, "failure": {"uuid": "u"}, "project": {"uuid": "p", "name": "n", "tech_stack": ["a"], "id": None}, "job": {"exit_code": "7", "baseline_duration_seconds": 3},
    "pipeline": {"changed_files": [{"path": "a.py", "additions": 2.0, "is_config": "yes", "patch": None}, {"path": "b"}]}, "source_context": [{"path": "x", "line": 1, "start_line": 1, "end_line": 2, "content": "c"}],
    "llm_override": {"provider": "stub", "n": [1]}, "use_rag": 0, "other": {"ignored": True},
}
# (path of what is changed, new value or ... to leave it out, violations)
BAD = [
    (("team_id",), ..., [("team_id", "missing")]),
    (("team_id",), "three", [("team_id", "int_type")]),
    (("team_id",), 3.5, [("team_id", "int_type")]),
    (("team_id",), None, [("team_id", "int_type")]),
    (("team_id",), 2**63, [("team_id", "int_type")]),
    (("failure",), [], [("failure", "model_type")]),
    (("failure", "uuid"), 5, [("failure.uuid", "string_type")]),
    (("failure", "is_flaky"), "maybe", [("failure.is_flaky", "bool_type")]),
    (("job", "exit_code"), 2**31, [("job.exit_code", "int_type")]),
    (("job", "baseline_duration_seconds"), "x", [("job.baseline_duration_seconds", "float_type")]),
    (("pipeline", "changed_files"), {}, [("pipeline.changed_files", "list_type")]),
    (("pipeline", "changed_files"), [{"path": "a"}, {}, 7], [("pipeline.changed_files[1].path", "missing"), ("pipeline.changed_files[2]", "model_type")]),
    (("project", "tech_stack"), ["a", None, 1], [("project.tech_stack[1]", "string_type"), ("project.tech_stack[2]", "string_type")]),
    (("source_context",), [{"line": "1"}], [(f"source_context[0].{x}", "missing") for x in ("path", "start_line", "end_line", "content")]),
    (("llm_override",), "key", [("llm_override", "dict_type")]),
    (("log_excerpt",), None, [("log_excerpt", "string_type")]),
]


def changed(path, value):
    request = json.loads(json.dumps(GOOD))
    at = request
    for x in path[:-1]:
        at = at[x]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(request)


def test_violations_are_named_by_path(spark):
    lines = [changed(p, v) for p, v, _ in BAD]
    more = [("{", [("", "json_invalid")]), ("[]", [("", "model_type")]), ('{"team_id": 1}', [(x, "missing") for x in ("failure", "project", "pipeline", "job")]), (json.dumps(GOOD), [])]
    want = [e for _, _, e in BAD] + [e for _, e in more]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, *(x for x, _ in more)])], "i int, value string")
    rows = sorted(contracts.checked(df, ANALYZE).collect())
    for r in rows:
        assert [tuple(e) for e in r.errors] == want[r.i], r.value
        assert (r.request is None) == bool(want[r.i])


def test_a_sound_request_has_its_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(GOOD) + '\n{"team_id": 1}\n')
    good, quarantine = io.read_checked_requests(spark, str(tmp_path / "r.json"))
    r = good.first().asDict(True)
    assert (r["team_id"], r["contract_version"], r["use_rag"], r["use_llm"], r["log_excerpt"], r["error_block"]) == (3, "v1", False, True, "", None)
    assert r["failure"] == {"uuid": "u", "occurrence_index": 1, "is_flaky": False, "signature_hash": None, "ecosystem": None}
    assert r["project"]["id"] is None and r["project"]["default_branch"] == "main" and r["project"]["tech_stack"] == ["a"]
    assert r["job"]["exit_code"] == 7 and r["job"]["status"] == "failed" and r["job"]["baseline_duration_seconds"] == 3.0
    assert [(f["path"], f["additions"], f["is_config"], f["change_type"]) for f in r["pipeline"]["changed_files"]] == [("a.py", 2, True, "modified"), ("b", 0, False, "modified")]
    assert json.loads(r["llm_override"]) == GOOD["llm_override"] and r["source_context"][0]["end_line"] == 2
    bad = quarantine.first()
    assert json.loads(bad.value) == {"team_id": 1} and len(bad.errors) == 4
    assert good.count() == quarantine.count() == 1
    assert good.schema.simpleString() == spark.createDataFrame([], schemas.ANALYZE_REQUESTS).schema.simpleString()


def test_every_request_of_the_test_tables_is_sound(spark):
    requests = queries.requests(spark, "/root/testdata/sf0.001").withColumn("project", F.col("project").withField("uuid", F.lit("p")))
    rows = requests.selectExpr("to_json(struct(*)) AS value")
    good, quarantine = contracts.split(rows, ANALYZE)
    assert quarantine.count() == 0 and good.count() == 1000


@pytest.mark.parametrize("name", sorted(contracts.CONTRACTS))
def test_schemas_go_there_and_back(name):
    contract = contracts.CONTRACTS[name]
    schema = contracts.json_schema(contract)
    again = contracts.from_json_schema(json.loads(json.dumps(schema)))
    assert contracts.json_schema(again) == schema and contracts.type_of(again) == contracts.type_of(contract)
    assert contracts.breaking(contract, again) == []
    assert set(schema.get("required", [])) == {k for k, v in contract.fields.items() if v.required}


def test_breaking_changes(tmp_path, monkeypatch):
    def other(**fields):
        return replace(ANALYZE, fields={k: v for k, v in {**ANALYZE.fields, **fields}.items() if v is not None})

    of = lambda **f: contracts.breaking(ANALYZE, other(**f))
    assert of(error_block=None) == [("error_block", "removed")]
    assert of(fresh=contracts.Value("string")) == [("fresh", "new and required")]
    assert of(fresh=contracts.Value("string", None, True)) == []
    assert of(team_id=contracts.Value("string")) == [("team_id", "type changed from integer to string")]
    assert of(team_id=contracts.Value("integer")) == [("team_id", "integer narrowed")]
    assert of(error_block=contracts.Value("string")) == [("error_block", "null no longer allowed"), ("error_block", "now required")]
    pipeline = replace(ANALYZE.fields["pipeline"], fields={k: v for k, v in ANALYZE.fields["pipeline"].fields.items() if k != "ref"})
    assert of(pipeline=pipeline) == [("pipeline.ref", "removed")]
    io.export_contracts(str(tmp_path))
    assert io.broken_contracts(str(tmp_path)) == {} and io.export_contracts(str(tmp_path)) == []
    monkeypatch.setitem(contracts.CONTRACTS, "analyze_requests", other(error_block=None))
    assert io.broken_contracts(str(tmp_path)) == {"analyze_requests": [("error_block", "removed")]}
    assert io.export_contracts(str(tmp_path)) == ["analyze_requests"]
