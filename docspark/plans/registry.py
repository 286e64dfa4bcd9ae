"""Every query of the engine's operators, with the SQL that checks it.

A query takes (spark, sf_dir) and runs over whole tables.  Oracles are DuckDB
SQL over the same tables; operators that are random, stateful or have no SQL
have none and are tested against known results instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader ``t(name) -> DataFrame``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            t.spark, t.folder = spark, sf_dir
            return f(t)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_analytics, queries_core, queries_state  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_analytics, queries_core, queries_state  # noqa: F401

    return dict(ORACLES)
