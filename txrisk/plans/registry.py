"""Registered queries over the test tables and their DuckDB SQL twins.

Each query reads whole tables from ``sf_dir`` and runs the library's
operators; each SQL twin computes the same result in plain ANSI SQL (global
windows are fine there: it is only the oracle).  Doubles are rounded to 6
places on both sides because float sums depend on evaluation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from txrisk.plans import q_build, q_metrics, q_slices  # noqa: F401
    from txrisk.plans import q_handoff, q_more, q_stream  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
