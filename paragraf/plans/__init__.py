"""Registered queries with their SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from ..session import ready

MODULES = ("retrieval", "graph", "evaluation", "citations", "corpus", "storage", "tools")


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""

    def prepared(query):
        @wraps(query)
        def run(spark, sf_dir):
            ready(spark)
            return query(spark, sf_dir)

        return run

    return {k: prepared(f) for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL of the same result."""
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
