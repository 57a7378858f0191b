"""All queries of the library by operator, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("identities", "joins", "aggregates", "ordered", "graphs", "benchmark", "scoring", "contracts", "inputs", "streams", "relations", "rollups", "scorers", "cells", "evaluation", "training")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def long_counts(sql: str) -> str:
    """DuckDB's count_if is wider than a long: each call gets a cast to the type of Spark's."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += f"{sql[at:i]}CAST({sql[i:j]} AS BIGINT)"
        at = j
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a query under the operator's name; sql gives the same rows where SQL can."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = long_counts(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quernstone.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
