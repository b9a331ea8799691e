"""All queries of the landmark operators."""

from __future__ import annotations

from . import agg_queries, clean_queries, eval_queries, grouped_queries, join_queries, joint_queries, landmark_queries, seq_queries, source_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
