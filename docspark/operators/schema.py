"""Schema rules: defaults and violations as columns, and unique-key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import _type_kind, resolve


class DuplicateKeyError(ValueError):
    code = 11000


def with_defaults(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    for name, rule in rules.items():
        if "default" in rule:
            value = F.lit(rule["default"])
            df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _checks(df: DataFrame, name: str, rule: dict) -> list[Column]:
    ref = resolve(df.schema, name)
    if ref.column is None:
        return [F.lit(f"{name}: required")] if rule.get("required") else []
    c, kind = ref.column, _type_kind(ref.type)
    kind = "array" if isinstance(ref.type, T.ArrayType) else "object" if isinstance(ref.type, (T.StructType, T.MapType)) else kind
    out = []
    say = lambda bad, what: out.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {what}")))
    if rule.get("required"):
        say(c.isNull(), "required")
    if "type" in rule and rule["type"] != kind:
        say(c.isNotNull(), f"type {rule['type']}")
        return out
    size = F.length(c) if kind == "string" else F.size(c) if kind == "array" else c
    for bound, test in (("min", lambda v: size < v), ("max", lambda v: size > v)):
        if bound in rule and kind in ("number", "string", "array"):
            say(test(rule[bound]), f"{bound} {rule[bound]}")
    if "match" in rule and kind == "string":
        say(~c.rlike(rule["match"]), "match")
    if "enum" in rule:
        say(~c.isin(list(rule["enum"])), "enum")
    if "validate" in rule:
        say(c.isNotNull() & ~F.coalesce(rule["validate"](c), F.lit(False)), "validate")
    return out


def violations(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows that break a rule, with ``_violations``."""
    checks = [c for name, rule in rules.items() for c in _checks(df, name, rule)]
    if not checks:
        return df.withColumn("_violations", F.array().cast("array<string>")).limit(0)
    return df.withColumn("_violations", F.array_compact(F.array(*checks))).where(F.size("_violations") > 0)


def validate(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows with defaults filled that break no rule; no rules return the table untouched."""
    if not rules:
        return df
    df = with_defaults(df, rules)
    checks = [c for name, rule in rules.items() for c in _checks(df, name, rule)]
    return df.where(F.size(F.array_compact(F.array(*checks))) == 0) if checks else df


def unique_violations(df: DataFrame, keys: list[str], sparse: bool = True) -> DataFrame:
    """Key values that occur more than once; sparse indexes skip rows without all keys."""
    if sparse:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
