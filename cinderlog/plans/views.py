"""Synthetic inputs of the queries, as SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

N = "' || chr(10) || '"
# One error for each kind of failure, and logs without a marker, with a blank line before it, or with cause and symptom.
TEMPLATES = [
    f"npm ERR! code ERESOLVE{N}npm ERR! unable to resolve dependency tree",
    "SQLSTATE[HY000] [2002] Connection refused while opening tcp://10.0.3.7:3306",
    "FATAL ERROR: JavaScript heap out of memory",
    "curl: (6) Could not resolve host: registry.internal",
    f"Traceback (most recent call last):{N}  File \"/srv/app/main.py\", line 12, in run{N}ValueError: bad input 1234",
    f"x509: certificate has expired{N}exit status 7",
    f"FAIL src/cart.test.ts{N}AssertionError: expected 3 to equal 4{N}Tests: 2 failed, 10 passed",
    f"SQLSTATE[28000] Access denied for user{N}FAILED tests/login_test{N}AssertionError",
    "deploy.sh: line 4: kubectl: command not found",
    f"  {N}{N}   ERROR something odd happened in step 3",
    "everything finished but the result is missing",
    f"Exception in thread \"main\" java.lang.IllegalStateException: worker 42{N}\tat com.acme.Job.run(Job.java:88)",
    "ERROR [3/7] RUN make: failed to solve: process did not complete successfully: exit code 2",
    f"mypy: error in app/models.py:17{N}error: 3 problems",
    "readiness probe failed: HTTP probe failed with status 503 for pod 3f2a9c1b7d4e",
    f"Permission denied (publickey) while reading /var/lib/run/secret.key{N}token = abcdef0123456789",
]
_CASE = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES)) + " END"
CI_LOGS = f"""SELECT event_id AS log_id, user_id % 5 AS team_id, user_id AS project_id, ts, event_type,
    '2024-01-05T10:00:00.123Z Fetching sources' || chr(10) || '##[group]Install' || chr(10) || chr(27) || '[32mok' || chr(27) || '[0m' || chr(10)
    || repeat('10:00:01.250 step done' || chr(10), CAST(event_id % 25 AS INT)) || 'Downloading layer ' || CAST(event_id AS STRING) || chr(10)
    || {_CASE} || chr(10) || 'pid=' || CAST(event_id % 900 AS STRING) || ' attempt ' || CAST(event_id % 3 AS STRING) || chr(10)
    || repeat('cleaning up files' || chr(10), CAST(event_id % 7 AS INT)) || 'ERROR: Job failed: exit code ' || CAST(1 + event_id % 3 AS STRING) || chr(10) AS raw_log
  FROM {{events}}"""
PROJECTS = "SELECT c_custkey AS id, 'p' || CAST(c_custkey AS STRING) AS name, c_custkey % 5 AS team_id, CASE WHEN c_custkey % 11 = 0 THEN c_name END AS deleted_at FROM {customer}"
FAILURES = """SELECT e.vec_id AS id, e.vec_id % 25 AS project_id, e.vec_id % 40 AS signature_id, CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE 'C' || CAST(e.label AS STRING) END AS category,
    'error ' || CAST(v.user_id AS STRING) AS error_message, v.ts AS failed_at, CASE WHEN e.vec_id % 2 = 0 THEN v.ts END AS resolved_at, CASE WHEN e.vec_id % 3 = 0 THEN 'note ' || CAST(e.vec_id AS STRING) END AS resolution_note
  FROM {embeddings} e JOIN {events} v ON e.vec_id = v.event_id"""
FAILURE_EMBEDDINGS = "SELECT vec_id AS failure_id, vec_id % 5 AS team_id, embedding FROM {embeddings}"
SIGNATURES = """SELECT n_nationkey AS id, n_nationkey % 5 AS team_id, 'h' || CAST(n_nationkey AS STRING) AS hash, n_name AS category, CAST(NULL AS STRING) AS subcategory, n_nationkey + 1 AS occurrence_count,
    n_nationkey % 2 = 0 AS is_known, 'cause ' || n_name AS known_root_cause, CASE WHEN n_nationkey % 4 = 0 THEN 'fix ' || n_name WHEN n_nationkey % 4 = 2 THEN '' END AS known_resolution FROM {nation}"""
KNOWLEDGE_DOCUMENTS = "SELECT doc_id AS id, 'doc ' || CAST(doc_id AS STRING) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 25 END AS project_id, doc_id % 10 <> 9 AS is_active FROM {documents}"
KNOWLEDGE_CHUNKS = "SELECT CAST((vec_id - vec_id % 5) / 5 AS BIGINT) AS document_id, CAST(vec_id % 5 AS INT) AS chunk_index, vec_id % 5 AS lane, 1 AS team_id, 'chunk ' || CAST(vec_id AS STRING) AS content, embedding FROM {embeddings}"
TEAMS = "SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 100.0 WHEN 3 THEN 1000000.0 ELSE 10000.0 END AS monthly_ai_budget_usd FROM {region}"
AI_REQUESTS = "SELECT user_id % 5 AS team_id, ROUND(CAST(value AS DOUBLE), 2) AS cost_usd, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'error' END AS status, ts AS created_at FROM {events}"
AS_OF = "2024-01-20 12:00:00"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in names})


def plain(sql: str) -> str:
    """The view's SQL over tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
