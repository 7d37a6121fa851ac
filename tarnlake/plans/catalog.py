"""Assembles the queries of the core: one module per family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.plans import history_queries, monitoring_queries, retrieval_queries, risk_queries, temporal_queries, text_queries

_FAMILIES = (history_queries, temporal_queries, retrieval_queries, risk_queries, text_queries, monitoring_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in _FAMILIES:
        found |= family.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in _FAMILIES:
        found |= family.oracle_sql()
    return found
