"""All queries of the object log with their oracle SQL."""

from __future__ import annotations

from tidelog.plans import oracle, queries, requests

QUERIES = queries.QUERIES | requests.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | requests.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
