"""All registered queries."""

from __future__ import annotations

from . import cohort_queries, prep_queries, score_queries, source_queries, stream_queries, summary_queries, time_queries  # noqa: F401  (they register themselves)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
