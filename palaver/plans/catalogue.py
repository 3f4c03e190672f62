"""All registered queries."""

from __future__ import annotations

from palaver.plans import q_corpus, q_dashboard, q_sessions, q_sources, q_streams, q_text, q_vectors  # noqa: F401
from palaver.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
