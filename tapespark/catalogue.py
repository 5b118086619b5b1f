"""Queries of the engine's operators on the sample tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import books, composed, evaluation, events, execution, ingest, labels, live, rolling, venues

MODULES = [rolling, events, books, labels, evaluation, execution, ingest, venues, live, composed]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
