"""Named queries and, where SQL can express them, the SQL to check them with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("scalars", "linking", "matching", "analysis", "reports")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLE[name] = oracle
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"weftline.queries.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
