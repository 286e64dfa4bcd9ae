"""Lookups and set operations.

A lookup groups the foreign side once and joins it, so its cost is that of one
equi-join; Catalyst chooses broadcast or shuffle from the sides' sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import resolve


def _keys(left: DataFrame, right: DataFrame, local: str, foreign: str) -> tuple[Column, Column]:
    """Join keys; as texts only if their types differ."""
    a, b = resolve(left.schema, local), resolve(right.schema, foreign)
    if a.column is None or b.column is None:
        raise ValueError(f"no field {local if a.column is None else foreign} to join by")
    if a.type == b.type or (isinstance(a.type, T.NumericType) and isinstance(b.type, T.NumericType)):
        return a.column, b.column
    return a.column.cast("string"), b.column.cast("string")


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, as_: str, *, single: bool = False, fields: list[str] | None = None, first_by: str | None = None) -> DataFrame:
    """Adds ``as_``: the matching foreign rows as an array of structs (empty if none), or the first one (null if none).

    First is the lowest ``first_by`` (default: ``_id``, else the foreign field).  Null keys match nothing.
    """
    mine, theirs = _keys(left, right, local, foreign)
    whole = F.struct(*(F.col(f"`{c}`") for c in (fields or right.columns)))
    order = F.col(first_by or ("_id" if "_id" in right.columns else foreign))
    gathered = F.min_by(whole, order) if single else F.collect_list(whole)
    grouped = right.where(theirs.isNotNull()).groupBy(theirs.alias("_lookup_key")).agg(gathered.alias("_lookup"))
    joined = left.withColumn("_local_key", mine).join(grouped, F.col("_local_key") == F.col("_lookup_key"), "left")
    found = F.col("_lookup") if single else F.coalesce(F.col("_lookup"), F.array().cast(T.ArrayType(grouped.schema["_lookup"].dataType.elementType)))
    return joined.withColumn(as_, found).drop("_local_key", "_lookup_key", "_lookup") if as_ not in ("_lookup",) else joined


def union_all(members: dict[str, DataFrame], tag: str = "_source") -> DataFrame:
    """Rows of all members, with the member's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in members.items()))


def federated(members: dict[str, DataFrame], spec: dict | None = None, *, sort: dict | None = None, limit: int = 0, tag: str = "_source") -> DataFrame:
    """One query over all members: filter, then one global sort and limit."""
    from .filters import find
    from .query import parse_sort, sort_columns

    df = find(union_all(members, tag), spec)
    if sort:
        df = df.orderBy(*sort_columns(df, parse_sort(sort)))
    return df.limit(limit) if limit else df


def federated_count(members: dict[str, DataFrame], spec: dict | None = None) -> int:
    from .filters import find

    return find(union_all(members), spec).count()


def intersect_ids(sets: list[DataFrame], key: str = "_id") -> DataFrame:
    """Identifiers that all sets have."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), sets[1:], sets[0].select(key).distinct())


def union_ids(sets: list[DataFrame], key: str = "_id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), (s.select(key) for s in sets)).distinct()


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Plain joins: inner, left, semi, anti, right, full, cross."""
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def unwind(df: DataFrame, path: str) -> DataFrame:
    """One row per element.  Null drops the row, an empty array keeps it with a null element, scalars pass."""
    name = path.lstrip("$")
    kind = df.schema[name].dataType
    df = df.where(F.col(name).isNotNull())
    if not isinstance(kind, T.ArrayType):
        return df
    return df.select(*(F.explode_outer(c).alias(c) if c == name else F.col(f"`{c}`") for c in df.columns))
