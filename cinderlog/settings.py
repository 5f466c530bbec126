"""Thresholds of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    similarity_threshold: float = 0.55
    max_similar_failures: int = 5
    knowledge_threshold: float = 0.40
    max_knowledge_seeds: int = 3
    neighbour_radius: int = 2
    max_knowledge_chunks: int = 6
    excerpt_context_lines: int = 15
    max_log_chars: int = 60_000
    strict_redaction: bool = True
    embedding_dimensions: int = 384
    embedding_batch: int = 32
    embedding_chars: int = 1000
    chunk_target_tokens: int = 150
    chunk_overlap_tokens: int = 25
    chars_per_token: int = 4
    rule_high: float = 0.85
    rule_low: float = 0.50
    entropy_threshold: float = 4.2
    signature_chars: int = 2000
    source_text_chars: int = 4000
    expected_answer_tokens: int = 180
    budget_warning_share: float = 0.8
    contract_version: str = "v1"
    service_version: str = "0.1.0"


DEFAULTS = Settings()
