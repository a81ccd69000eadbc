"""Queries over the driver's tables, one or more for each operator, with the equivalent SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_TYPES = {"l": ("long", "bigint"), "d": ("double", "double"), "s": ("string", "varchar"), "b": ("boolean", "boolean")}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query whose result has the columns `name:type …`, in both engines."""
    parts = [c.split(":") for c in columns.split()]

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[F.col(c).cast(_TYPES[t][0]).alias(c) for c, t in parts])

        _QUERIES[name] = run
        if sql:
            from threadloom.plans.relations import SQL_LINES

            numbered = re.sub(r"\bfrom lineitem\b", f"from {SQL_LINES}", sql)
            _SQL[name] = f"select {', '.join(f'{c}::{_TYPES[t][1]} as {c}' for c, t in parts)} from ({numbered}) as result"
        return f

    return register


def _load() -> None:
    from threadloom.plans import graph_queries, interval_queries, kmer_queries, mapping_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
