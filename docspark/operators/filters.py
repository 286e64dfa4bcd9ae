"""Filter documents compiled to two-valued Columns.

A filter document such as ``{"age": {"$gte": 30}, "$or": [...]}`` becomes one
Catalyst expression that is TRUE or FALSE for every row, never NULL, so that
``$not``, ``$nor`` and ``$nin`` complement exactly.  In a WHERE, NULL rejects a
row as FALSE does; there the conditions stay plain, so that they reach the scan.  A field that the schema
lacks is a missing field; in typed columns missing and null are the same.
VARIANT columns are addressed by path and keep the difference.

Deviations that are deliberate: unknown operators raise; ordering comparisons
on NaN are false; equality never converts between types.
"""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = True, False


class FilterError(ValueError):
    """A filter document that can't be compiled."""


@dataclass
class Ref:
    """A value that a path leads to: its Column (None: missing) and type; for VARIANT, the JSON path within it."""

    column: Column | None
    type: T.DataType | None
    path: str | None = None

    def as_type(self, kind: str) -> Column:
        return F.try_variant_get(self.column, self.path, kind)


def resolve(schema: T.StructType, path: str, column=F.col) -> Ref:
    """The value at a dotted path; number segments index arrays."""
    parts = path.split(".")
    names = {f.name: f for f in schema.fields}
    if path in names:  # a column whose own name has dots
        return Ref(column(f"`{path}`") if column is F.col else column(path), names[path].dataType)
    if parts[0] not in names:
        return Ref(None, None)
    return descend(Ref(column(f"`{parts[0]}`") if column is F.col else column(parts[0]), names[parts[0]].dataType), parts[1:])


def descend(ref: Ref, parts: list[str]) -> Ref:
    for k, part in enumerate(parts):
        if isinstance(ref.type, T.VariantType):
            return Ref(ref.column, ref.type, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts[k:]))
        if isinstance(ref.type, T.StructType):
            found = next((f for f in ref.type.fields if f.name == part), None)
            if found is None:
                return Ref(None, None)
            ref = Ref(ref.column.getField(part), found.dataType)
        elif isinstance(ref.type, T.MapType):
            ref = Ref(F.try_element_at(ref.column, F.lit(part)), ref.type.valueType)
        elif isinstance(ref.type, T.ArrayType) and part.isdigit():
            ref = Ref(F.get(ref.column, F.lit(int(part))), ref.type.elementType)
        else:
            return Ref(None, None)
    if isinstance(ref.type, T.VariantType) and ref.path is None:
        return Ref(ref.column, ref.type, "$")
    return ref


def sure(condition: Column) -> Column:
    """NULL as FALSE."""
    return F.coalesce(condition, F.lit(False))


def _no(condition: Column) -> Column:
    """The complement of a condition whose NULL means FALSE."""
    return ~sure(condition)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "time"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    return "other"


def _type_kind(kind: T.DataType | None) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.BinaryType):
        return "binary"
    return "other"


def _text(ref: Ref) -> Column:
    """String(value), with whole doubles written without a fraction."""
    if isinstance(ref.type, T.VariantType):
        return ref.as_type("string")
    text = ref.column.cast("string")
    return F.regexp_replace(text, r"\.0$", "") if isinstance(ref.type, (T.DoubleType, T.FloatType)) else text


def literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*(literal(v) for v in value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    return F.lit(value)


def equals(ref: Ref, value: Any) -> Column:
    """Strict equality; None matches null and missing."""
    if value is None:
        if ref.column is None:
            return F.lit(True)
        if ref.path is not None:
            found = F.try_variant_get(ref.column, ref.path, "variant")
            return found.isNull() | (F.is_variant_null(found))
        return ref.column.isNull()
    if ref.column is None:
        return F.lit(False)
    if ref.path is not None:
        kind = {"number": "double", "string": "string", "boolean": "boolean"}.get(_kind(value))
        if kind is None:
            return (F.to_json(F.try_variant_get(ref.column, ref.path, "variant")) == F.to_json(literal(value)))
        same_type = F.schema_of_variant(F.try_variant_get(ref.column, ref.path, "variant")).rlike({"number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "string": "^STRING", "boolean": "^BOOLEAN"}[_kind(value)])
        return ((ref.as_type(kind) == F.lit(value)) & same_type)
    if isinstance(value, (list, tuple)):
        if not isinstance(ref.type, T.ArrayType):
            return F.lit(False)
        return (ref.column == literal(value).cast(ref.type)) if value else (F.size(ref.column) == 0)
    if isinstance(value, dict):
        if not isinstance(ref.type, T.StructType):
            return F.lit(False)
        return _all([equals(descend(ref, [k]), v) for k, v in value.items()])
    mine, theirs = _type_kind(ref.type), _kind(value)
    if mine == "time" and theirs == "string":
        return (ref.column == F.try_to_timestamp(F.lit(value)).cast(ref.type))
    if mine != theirs:
        return F.lit(False)
    return (ref.column == F.lit(value))


def compare(ref: Ref, op: str, value: Any) -> Column:
    """Ordering comparison; numbers and texts convert to numbers, anything that doesn't convert is FALSE."""
    if ref.column is None or value is None:
        return F.lit(False)
    mine = _type_kind(ref.type)
    left, right = ref.column, F.lit(value)
    if ref.path is not None:
        left = ref.as_type("string" if _kind(value) == "string" else "double")
    elif mine == "time":
        right = F.try_to_timestamp(F.lit(value)).cast(ref.type) if _kind(value) == "string" else F.lit(value).cast(ref.type)
    elif mine != _kind(value):
        left, right = (c.cast("double") if k in ("number", "boolean") else c.try_cast("double") for c, k in ((left, mine), (right, _kind(value))))
    test = {"$gt": lambda: left > right, "$gte": lambda: left >= right, "$lt": lambda: left < right, "$lte": lambda: left <= right}[op]()
    if isinstance(ref.type, (T.DoubleType, T.FloatType)):
        test = test & ~F.isnan(ref.column)
    return (test)


def _among(ref: Ref, values: list) -> Column:
    """Membership; an array matches if it shares an element."""
    if ref.column is None:
        return F.lit(None in values)
    if isinstance(ref.type, T.ArrayType):
        if not values:
            return F.lit(False)
        return (F.exists(ref.column, lambda x: _any([equals(Ref(x, ref.type.elementType), v) for v in values])))
    plain = [v for v in values if v is not None and _kind(v) == _type_kind(ref.type)]
    if ref.path is not None:
        return _any([equals(ref, v) for v in values])
    tests = [(ref.column.isin(plain))] if plain else []
    if None in values:
        tests.append(ref.column.isNull())
    return _any(tests)


def _holds(ref: Ref, value: Any) -> Column:
    """Some element of the array equals the value."""
    return (F.exists(ref.column, lambda x: equals(Ref(x, ref.type.elementType), value)))


def _unequal(ref: Ref, value: Any) -> Column:
    if ref.column is not None and ref.path is None and value is not None and _kind(value) == _type_kind(ref.type) and _kind(value) != "other":
        return ~ref.column.eqNullSafe(F.lit(value))
    return _no(equals(ref, value))


def _outside(ref: Ref, values: list) -> Column:
    """Not among the values; null and missing are outside unless listed."""
    plain = [v for v in values if v is not None and _kind(v) == _type_kind(ref.type)]
    if ref.column is not None and ref.path is None and _type_kind(ref.type) != "other" and plain:
        inside = ref.column.isin(plain)
        return ref.column.isNotNull() & ~inside if None in values else ref.column.isNull() | ~inside
    return _no(_among(ref, values))


def java_regex(pattern: Any, options: str | None) -> str:
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
        pattern = pattern.pattern
    else:
        flags = "".join(f for f in (options or "") if f in "imsx")
    return f"(?{flags}){pattern}" if flags else pattern


def matches(ref: Ref, pattern: Any, options: str | None) -> Column:
    return F.lit(False) if ref.column is None else (_text(ref).rlike(java_regex(pattern, options)))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for i, t in enumerate(tests):
        out = t if i == 0 else out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for i, t in enumerate(tests):
        out = t if i == 0 else out | t
    return out


def js_type(ref: Ref) -> Column:
    """Name of the value's type as JavaScript has it; 'undefined' where it is missing."""
    if ref.column is None:
        return F.lit("undefined")
    if ref.path is not None:
        found = F.schema_of_variant(F.try_variant_get(ref.column, ref.path, "variant"))
        return F.when(found.isNull(), "undefined").when(found == "VOID", "null").when(found.startswith("ARRAY"), "array").when(found.startswith("OBJECT"), "object").when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").otherwise("number")
    name = "array" if isinstance(ref.type, T.ArrayType) else {"number": "number", "string": "string", "boolean": "boolean"}.get(_type_kind(ref.type), "object")
    return F.when(ref.column.isNull(), "null").otherwise(name)


def condition(ref: Ref, spec: Any) -> Column:
    """A field's condition: a value, a regular expression, or a document of operators."""
    from ..functions import scalars

    if isinstance(spec, re.Pattern):
        return matches(ref, spec, None)
    if not isinstance(spec, dict) or not any(k.startswith("$") for k in spec):
        return equals(ref, spec)
    tests = []
    for op, value in spec.items():
        if op == "$eq":
            tests.append(equals(ref, value))
        elif op == "$ne":
            tests.append(_unequal(ref, value))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            tests.append(compare(ref, op, value))
        elif op == "$in":
            tests.append(_among(ref, list(value)))
        elif op == "$nin":
            tests.append(_outside(ref, list(value)))
        elif op == "$exists":
            there = F.lit(False) if ref.column is None else F.try_variant_get(ref.column, ref.path, "variant").isNotNull() if ref.path is not None else ref.column.isNotNull()
            tests.append(there if value else ~there)
        elif op == "$type":
            tests.append((js_type(ref) == F.lit(value)))
        elif op == "$size":
            tests.append((F.size(ref.column) == F.lit(value)) if isinstance(ref.type, T.ArrayType) else F.lit(False))
        elif op == "$all":
            held = isinstance(ref.type, T.ArrayType) and ref.column is not None
            tests.append((ref.column.isNotNull() & _all([_holds(ref, v) for v in value])) if held else F.lit(False))
        elif op == "$elemMatch":
            tests.append((F.exists(ref.column, lambda x: element(Ref(x, ref.type.elementType), value))) if isinstance(ref.type, T.ArrayType) else F.lit(False))
        elif op == "$regex":
            tests.append(matches(ref, value, spec.get("$options", "i")))
        elif op == "$mod":
            divisor, rest = value
            number = None if ref.column is None else ref.as_type("double") if ref.path is not None else ref.column if _type_kind(ref.type) == "number" else ref.column.try_cast("double")
            tests.append(F.lit(False) if number is None else (F.try_mod(number, F.lit(divisor)) == F.lit(rest)))
        elif op == "$not":
            tests.append(_no(condition(ref, value)))
        elif op == "$fuzzy":
            most = spec.get("maxDistance", spec.get("$maxDistance", 1))
            wanted = value
            if isinstance(value, dict):
                wanted, most = value.get("value", value.get("$value")), value.get("maxDistance", most)
            tests.append(F.lit(False) if ref.column is None else (scalars.fuzzy(_text(ref), str(wanted), int(most))))
        elif op == "$soundex":
            tests.append(F.lit(False) if ref.column is None else (scalars.sounds_like(_text(ref), str(value))))
        elif op == "$substr":
            tests.append(F.lit(False) if ref.column is None else (F.lower(_text(ref)).contains(str(value).lower())))
        elif op in ("$options", "maxDistance", "$maxDistance"):
            continue
        else:
            raise FilterError(f"unknown operator {op}")
    return _all(tests)


def element(ref: Ref, spec: Any) -> Column:
    """An array element against a sub-filter (structs) or a condition (scalars)."""
    if isinstance(ref.type, T.StructType) and isinstance(spec, dict) and not any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
        return _compile(spec, ref.type, ref.column.getField)
    return condition(ref, spec)


def compile_filter(spec: dict, schema: T.StructType, column=F.col) -> Column:
    """The two-valued Column of a filter document over rows of ``schema``."""
    return sure(_compile(spec, schema, column))


def _compile(spec: dict, schema: T.StructType, column=F.col) -> Column:
    """As ``compile_filter``, with NULL for FALSE in places: enough for a WHERE, and plain enough to reach the scan."""
    if not isinstance(spec, dict):
        raise FilterError("a filter is a document")
    tests = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)):
                tests.append(F.lit(False))
                continue
            parts = [_compile(v, schema, column) for v in value]
            tests.append(_all(parts) if key == "$and" else _any(parts) if key == "$or" else _no(_any(parts)))
        elif key == "$not":
            tests.append(_no(_compile(value, schema, column)))
        elif key == "$ids":
            tests.append(_among(resolve(schema, "_id", column), list(value)))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        else:
            tests.append(condition(resolve(schema, key, column), value))
    return _all(tests)


def find(df: DataFrame, spec: dict | None = None) -> DataFrame:
    """Rows that match; an empty filter is the whole table, without a limit."""
    return df.where(_compile(spec, df.schema)) if spec else df
