"""All queries outside the llm subpackage, by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE dictionaries.
MODULES: tuple[str, ...] = ("retrieval", "tables", "more", "rules", "ingest", "stored")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"passages.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"passages.plans.{name}").ORACLE
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched retrieval of all benchmark queries with fusion and neighbours."""
    return queries()["ctx10_retrieve"](spark, sf_dir)
