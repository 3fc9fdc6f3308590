"""All queries over the driver's tables and their oracle SQL."""

from __future__ import annotations

from examloom.plans import analytics, dedup, harness, relational, retrieval, rules, scores, stores, text
from examloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "dedup", "harness", "relational", "retrieval", "rules", "scores", "stores", "text"]
