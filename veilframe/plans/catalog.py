"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.plans import corpora, evaluation, relational, scalar, stateful

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (evaluation, relational, scalar, stateful, corpora)


def queries() -> dict[str, Query]:
    """All queries of the library's own operators."""
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL of those queries that SQL can express."""
    return {name: text for m in MODULES for name, text in m.ORACLE.items()}
