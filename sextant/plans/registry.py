"""Registered queries: name to (function of ``Tables``, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.plans.derived import Tables, oracle

Query = Callable[[Tables], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        if name in _found:
            raise ValueError(f"two queries are called {name}")
        _found[name] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for k, (f, _) in _found.items()}


def oracles() -> dict[str, str]:
    return {k: oracle(sql) for k, (_, sql) in _found.items() if sql}
