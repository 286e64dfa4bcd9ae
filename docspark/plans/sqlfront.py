"""SQL over collections: Spark SQL, with the compatible LIKE as a rewrite."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LIKE = re.compile(r"(?i)\b([\w.`]+)\s+LIKE\s+'((?:[^']|'')*)'")
_ORDER = re.compile(r"(?i)\bORDER\s+BY\s+([\w.`]+)(\s+(?:ASC|DESC))?(?!\s*(?:,|NULLS|\())\b")


def contains_like(query: str) -> str:
    """LIKE as case-insensitive containment: its percent signs are ignored."""
    return _LIKE.sub(lambda m: f"contains(lower(CAST({m[1]} AS STRING)), lower('{m[2].replace('%', '')}'))", query)


def nulls_last(query: str) -> str:
    """A single ORDER BY key puts missing values last in both directions."""
    return _ORDER.sub(lambda m: f"ORDER BY {m[1]}{m[2] or ''} NULLS LAST", query)


def execute(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, *, compatible: bool = True) -> DataFrame:
    """The result of a query over the tables; ``compatible`` False leaves the query as standard SQL."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(nulls_last(contains_like(query)) if compatible else query)
