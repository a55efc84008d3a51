"""All queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.plans import catalogue, core_problems, planner, quality, search, textual

BOOKS = (search.q, catalogue.q, quality.q, textual.q, planner.q)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for b in BOOKS for k, f in b.queries.items()} | core_problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: s for b in BOOKS for k, s in b.oracle.items()} | core_problems.ORACLE
