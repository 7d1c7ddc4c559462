"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

from frameflow.plans import table_queries, trajectory_queries, vector_queries  # noqa: F401
from frameflow.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
