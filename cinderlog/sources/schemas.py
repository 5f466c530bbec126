"""Input schemas as DDL."""

LOGS = "log_id BIGINT, raw_log STRING, job_name STRING, stage_name STRING, exit_code INT, strict_redaction BOOLEAN"
ANALYZE_REQUESTS = """contract_version STRING, team_id BIGINT,
  failure STRUCT<uuid STRING, occurrence_index INT, is_flaky BOOLEAN, signature_hash STRING, ecosystem STRING>,
  project STRUCT<id BIGINT, uuid STRING, name STRING, tech_stack ARRAY<STRING>, provider STRING, default_branch STRING>,
  pipeline STRUCT<iid INT, ref STRING, source STRING, commit_sha STRING, commit_message STRING, duration_seconds INT, previous_status STRING,
    changed_files ARRAY<STRUCT<path STRING, change_type STRING, additions INT, deletions INT, is_config BOOLEAN, is_dependency BOOLEAN, patch STRING, patch_truncated BOOLEAN>>>,
  job STRUCT<name STRING, stage_name STRING, status STRING, exit_code INT, duration_seconds INT, failure_reason STRING, baseline_duration_seconds DOUBLE>,
  log_excerpt STRING, error_block STRING, stack_trace STRING,
  source_context ARRAY<STRUCT<path STRING, line INT, start_line INT, end_line INT, content STRING>>,
  use_rag BOOLEAN, use_llm BOOLEAN, force_llm BOOLEAN, llm_override STRING"""
SIMILAR_REQUESTS = "team_id BIGINT, error_message STRING, category STRING, ecosystem STRING, job_name STRING, exclude_failure_id BIGINT, `limit` INT, threshold DOUBLE"
CHUNK_REQUESTS = "text STRING, title STRING, target_tokens INT, overlap_tokens INT"
RECOMMENDATION = "STRUCT<title STRING, description STRING, rationale STRING, action_type STRING, risk STRING, confidence STRING, affected_files ARRAY<STRING>, patch STRING>"
FAILURE_EMBEDDINGS = "failure_id BIGINT, signature_id BIGINT, team_id BIGINT, embedding ARRAY<FLOAT>, model STRING, dimensions INT, source_text STRING, created_at TIMESTAMP"
ALL = {"logs": LOGS, "analyze_requests": ANALYZE_REQUESTS, "similar_requests": SIMILAR_REQUESTS, "chunk_requests": CHUNK_REQUESTS, "failure_embeddings": FAILURE_EMBEDDINGS}
