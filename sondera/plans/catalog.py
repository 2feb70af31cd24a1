"""Registered queries of the engine: a callable and, where SQL can say it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import STEADY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with its SQL, whose `round(x, 6) + 0.0` means expr.r6."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace(", 6) + 0.0", f" + {STEADY!r}, 6) + 0.0")
        return f

    return put
