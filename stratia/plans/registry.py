"""All queries over the driver's tables, with the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratia.plans import analytics, evidence, graph, kept, laws, logic, methods, provability, quantities, review, statements, symmetry

MODULES = (graph, statements, methods, logic, laws, evidence, review, quantities, provability, symmetry, analytics, kept)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
