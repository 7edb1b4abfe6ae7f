"""Registration of queries and composition of their SQL equivalents."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codonloom.catalog.views import VIEWS, Tables, view_sql

_MODULES = ("shaping", "joining", "counting", "ranking", "reshaping", "enriching", "assembling",
            "files", "balancing", "judging", "learning")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
# Named intermediate results that several SQL texts share.
STEPS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` with an optional equivalent SQL text."""
    def register(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def with_parts(sql: str) -> str:
    """Prefix `sql` with the views and steps it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str):
        for name in [*VIEWS, *STEPS]:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(view_sql(name) if name in VIEWS else STEPS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    parts = [f"{n} as ({view_sql(n) if n in VIEWS else STEPS[n]})" for n in ordered]
    body = sql.lstrip()
    if body.startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(parts) + "\n" + body


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"codonloom.catalog.{module}")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return {name: with_parts(sql) for name, sql in _SQL.items()}
