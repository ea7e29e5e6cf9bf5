"""Where queries are registered with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from chronolake.plans.views import oracle

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(views: list[str] | None = None, sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL of the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(views or [], sql)
        return f

    return add
