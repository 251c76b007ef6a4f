"""Named queries: each module adds Query records; queries() and oracle_sql() are views of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ["relational", "temporal", "curation", "textual", "metrics", "weather", "connectors"]


@dataclass(frozen=True)
class Query:
    """A query over the test tables; sql is its DuckDB counterpart, None where SQL cannot express it."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def collected(groups: Iterable[Iterable[Query]]) -> list[Query]:
    """All queries of the groups; a name that repeats is an error."""
    found = [q for group in groups for q in group]
    names = [q.name for q in found]
    if len(names) != len(set(names)):
        raise ValueError(f"query names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    return found


def all_queries() -> list[Query]:
    return collected(importlib.import_module(f"quern.plans.{name}").QUERIES for name in MODULES)


def selected(prefix: str) -> list[Query]:
    """The queries whose names begin so, by name."""
    return sorted((q for q in all_queries() if q.name.startswith(prefix)), key=lambda q: q.name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in all_queries()}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in all_queries() if q.sql is not None}
