"""Operators for preparing training text at scale; importing this package fills the registry of their queries."""

from catalumen.llm import conversations, decontaminate, embedding_dup, hard_negatives, language_id, near_dup, neighbours, packing, secret_scan, substring_dedup, suffix_dedup, toxicity, warc  # noqa: F401
from catalumen.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
