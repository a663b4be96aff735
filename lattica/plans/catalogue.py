"""Every query over the driver's tables, by name."""

from __future__ import annotations

from lattica.plans import claim_queries, context_queries, corpus_queries, evidence_queries, interval_queries, name_queries, slot_queries, text_queries, vote_queries  # noqa: F401 - they enter their queries
from lattica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
