"""Aggregation pipelines: a list of stages folded over a DataFrame, in order.

Catalyst pushes filters and prunes columns across stages, so nothing is moved
by hand.  Unknown stages and accumulators raise.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import joins
from .filters import find, literal, resolve
from .query import parse_projection, parse_sort, project, sort_columns


class PipelineError(ValueError):
    """A stage or accumulator that isn't known."""


def _value(df: DataFrame, spec: Any) -> Column:
    """'$path' is a field (null if missing), everything else a literal."""
    if isinstance(spec, str) and spec.startswith("$"):
        ref = resolve(df.schema, spec[1:])
        if ref.column is None:
            return F.lit(None)
        return ref.as_type("string") if ref.path else ref.column
    return literal(spec)


def number(df: DataFrame, spec: Any) -> Column:
    """A numeric argument; what isn't a number is null."""
    value = _value(df, spec)
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    return value.try_cast("double") if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def accumulator(df: DataFrame, op: str, spec: Any) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    if op == "$sum":
        return zero(F.sum(zero(number(df, spec))))
    if op == "$avg":  # over all rows: a missing value counts as 0
        return zero(F.avg(zero(number(df, spec)).cast("double")))
    if op == "$count":
        return F.count(F.lit(1))
    if op in ("$min", "$max"):
        value = _value(df, spec)
        return F.min(value) if op == "$min" else F.max(value)
    if op in ("$first", "$last"):
        tie = F.struct(*(F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))))
        return (F.min_by if op == "$first" else F.max_by)(_value(df, spec), tie)
    if op == "$push":
        return F.collect_list(_value(df, spec))
    if op == "$addToSet":
        return F.collect_set(_value(df, spec))
    if op == "$stdDev":
        return F.stddev_pop(number(df, spec))
    if op == "$approxDistinct":
        return F.approx_count_distinct(_value(df, spec))
    if op == "$percentile":
        return F.percentile_approx(number(df, spec["input"]), spec.get("p", 0.5), spec.get("accuracy", 10_000))
    raise PipelineError(f"unknown accumulator {op}")


def group(df: DataFrame, spec: dict) -> DataFrame:
    """``_id``: null for one group, '$field', or a document of several keys."""
    by = spec.get("_id")
    outputs = []
    for name, acc in spec.items():
        if name != "_id":
            ((op, value),) = acc.items()
            outputs.append(accumulator(df, op, value).alias(name))
    outputs = outputs or [F.count(F.lit(1)).alias("count")]
    if by is None:
        out = df.agg(*outputs)
        return out.select(F.lit(None).cast("string").alias("_id"), *out.columns)
    if isinstance(by, dict):
        keys = [_value(df, v).alias(k) for k, v in by.items()]
        out = df.groupBy(*keys).agg(*outputs)
        rest = [c for c in out.columns if c not in by]
        return out.select(F.struct(*by).alias("_id"), *rest)
    return df.groupBy(_value(df, by).alias("_id")).agg(*outputs)


def aggregate(df: DataFrame, stages: list[dict], collections: dict[str, DataFrame] | None = None, *, key: str = "_id") -> DataFrame:
    """The result of the stages; no stages give the input."""
    collections = collections or {}
    for stage in stages:
        ((name, spec),) = stage.items()
        if name == "$match":
            df = find(df, spec)
        elif name == "$lookup":
            source = spec["from"]
            other = collections[source] if isinstance(source, str) else source
            df = joins.lookup(df, other, spec["localField"], spec["foreignField"], spec["as"], single=bool(spec.get("single")), fields=spec.get("fields"))
        elif name == "$unwind":
            df = joins.unwind(df, spec if isinstance(spec, str) else spec["path"])
        elif name in ("$addFields", "$set"):
            df = df.withColumns({k: _value(df, v) if name == "$set" else literal(v) for k, v in spec.items()})
        elif name == "$project":
            df = project(df, parse_projection(spec), key)
        elif name == "$group":
            df = group(df, spec)
        elif name == "$sort":
            df = df.orderBy(*sort_columns(df, parse_sort(spec), key))
        elif name == "$limit":
            df = df.limit(int(spec))
        elif name == "$skip":
            df = df.offset(int(spec))
        elif name == "$count":
            df = df.agg(F.count(F.lit(1)).alias(spec))
        elif name == "$replaceRoot":
            df = df.select(_value(df, spec["newRoot"]).alias("_root")).select("_root.*")
        elif name == "$sample":
            df = df.orderBy(F.xxhash64(F.lit(spec.get("seed", 0)), *(F.col(f"`{c}`") for c in df.columns))).limit(int(spec["size"]))
        elif name == "$groupingSets":
            df = grouping_sets(df, spec)
        elif name == "$geoNear":
            from .geo import near

            df = near(df, tuple(spec["near"]), field=spec.get("key", "location"), max_distance=spec.get("maxDistance"), min_distance=spec.get("minDistance"))
        elif name == "$out":
            df.write.mode(spec.get("mode", "overwrite")).format(spec.get("format", "parquet")).save(spec["path"])
        else:
            raise PipelineError(f"unknown stage {name}")
    return df


def grouping_sets(df: DataFrame, spec: dict) -> DataFrame:
    """{'keys': [...], 'mode': 'cube' | 'rollup', outputs}."""
    outputs = [accumulator(df, *next(iter(acc.items()))).alias(name) for name, acc in spec.items() if name not in ("keys", "mode")]
    return getattr(df, spec.get("mode", "cube"))(*spec["keys"]).agg(*outputs)
