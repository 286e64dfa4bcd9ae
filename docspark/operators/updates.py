"""Update documents as column rewrites, and the collection mutations built of them.

Data is immutable: a mutation takes a DataFrame and gives the changed one.
``first match`` is the matching row of the lowest identifier.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Ref, compile_filter, equals, find, literal, resolve, sure


class UpdateError(ValueError):
    """An update document that can't be compiled."""


OPERATORS = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$currentDate", "$push", "$pull", "$addToSet", "$pop")


def _unequal(element: Column, kind: T.DataType, value: Any) -> Column:
    """Not pulled by value; a document pulls elements of which any listed key is equal."""
    ref = Ref(element, kind)
    if isinstance(value, dict) and isinstance(kind, T.StructType):
        hit = F.lit(False)
        for k, v in value.items():
            if k in kind.names:
                hit = hit | sure(equals(Ref(element.getField(k), kind[k].dataType), v))
        return ~hit
    return ~sure(equals(ref, value))


def changed(ref: Ref, op: str, value: Any, now: Any = None) -> Column:
    """The new value of one field under one operator."""
    c, kind = ref.column, ref.type
    if op == "$set":
        return literal(value).cast(kind) if kind is not None else literal(value)
    if op == "$unset":
        return F.lit(None).cast(kind) if kind is not None else F.lit(None)
    if op in ("$inc", "$mul"):
        base = F.coalesce(c, F.lit(0).cast(kind)) if c is not None else F.lit(0)
        out = base + F.lit(value) if op == "$inc" else base * F.lit(value)
        return out.cast(kind) if kind is not None and not (isinstance(value, float) and isinstance(kind, T.IntegralType)) else out
    if op in ("$min", "$max"):
        if c is None:
            return literal(value)
        other = literal(value).cast(kind)
        return F.least(c, other) if op == "$min" else F.greatest(c, other)
    if op == "$currentDate":
        when = F.lit(now) if now is not None else F.current_timestamp()
        return F.unix_millis(when.cast("timestamp")) if value in ("timestamp", {"$type": "timestamp"}) else when.cast(kind or "timestamp")
    many = isinstance(value, dict) and "$each" in value
    items = list(value["$each"]) if many else [value]
    if op == "$push":
        new = literal(items)
        if c is None:
            out = new
        else:
            base, new = F.coalesce(c, F.array().cast(kind)), new.cast(kind)
            place = value.get("$position") if many else None
            if place is None:
                out = F.concat(base, new)
            else:
                at = F.lit(int(place)) if place >= 0 else F.greatest(F.size(base) + int(place), F.lit(0))
                at = F.least(at, F.size(base))
                out = F.concat(F.slice(base, F.lit(1), at), new, F.slice(base, at + 1, F.size(base)))
        if many and "$slice" in value:
            n = int(value["$slice"])
            out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(-n))
        return out
    if op == "$addToSet":
        if c is None:
            return F.array_distinct(literal(items))
        base = F.coalesce(c, F.array().cast(kind))
        return F.concat(base, F.array_except(F.array_distinct(literal(items).cast(kind)), base))
    if c is None or not isinstance(kind, T.ArrayType):
        return c if c is not None else F.lit(None)
    if op == "$pull":
        return F.filter(c, lambda x: _unequal(x, kind.elementType, value))
    if op == "$pop":
        rest = F.greatest(F.size(c) - 1, F.lit(0))
        return F.slice(c, F.lit(2), rest) if value == -1 else F.slice(c, F.lit(1), rest)
    raise UpdateError(f"unknown update operator {op}")


def _assign(df: DataFrame, path: str, new: Column, where: Column, drop: bool = False) -> DataFrame:
    top, _, rest = path.partition(".")
    if not rest:
        if top in df.columns:
            return df.withColumn(top, F.when(where, new).otherwise(F.col(f"`{top}`")))
        return df.withColumn(top, F.when(where, new))
    if top not in df.columns:
        for part in reversed(rest.split(".")):
            new = F.struct(new.alias(part))
        return df.withColumn(top, F.when(where, new))
    kind, parts = df.schema[top].dataType, rest.split(".")
    known = resolve(df.schema, path).column is not None
    base = F.coalesce(F.col(f"`{top}`"), F.from_json(F.lit("{}"), kind)) if isinstance(kind, T.StructType) else F.col(f"`{top}`")
    if not known:  # add the field to every row, so that the type is one, and fill it where the filter holds
        missing = F.when(where, new)
        for i in range(len(parts) - 1, 0, -1):
            if resolve(df.schema, ".".join([top, *parts[:i]])).column is not None:
                return df.withColumn(top, F.when(where | F.col(top).isNotNull(), base.withField(".".join(parts[: i + 1]), _nest(missing, parts[i + 1 :]))))
        return df.withColumn(top, F.when(where | F.col(top).isNotNull(), base.withField(parts[0], _nest(missing, parts[1:]))))
    return df.withColumn(top, F.when(where, base.withField(rest, new)).otherwise(F.col(f"`{top}`")))


def _nest(value: Column, parts: list[str]) -> Column:
    for part in reversed(parts):
        value = F.struct(value.alias(part))
    return value


def apply_update(df: DataFrame, update: dict, where: Column | None = None, *, key: str = "_id", now: Any = None) -> DataFrame:
    """Rows with the update applied where the condition holds; a document without operators replaces all but the identifier."""
    where = F.lit(True) if where is None else where
    df = df.withColumn("_hit", where)
    hit = F.col("_hit")
    if not any(k.startswith("$") for k in update):
        for f in df.schema.fields:
            if f.name in (key, "_hit"):
                continue
            new = literal(update[f.name]).cast(f.dataType) if f.name in update else F.lit(None).cast(f.dataType)
            df = df.withColumn(f.name, F.when(hit, new).otherwise(F.col(f"`{f.name}`")))
        for name in update:
            if name not in df.columns:
                df = df.withColumn(name, F.when(hit, literal(update[name])))
        return df.drop("_hit")
    for op, fields in update.items():
        if op not in OPERATORS:
            raise UpdateError(f"unknown update operator {op}")
        for path, value in fields.items():
            ref = resolve(df.schema, path)
            if op == "$unset" and ref.column is None:
                continue
            df = _assign(df, path, changed(ref, op, value, now), hit)
    return df.drop("_hit")


def _first(df: DataFrame, spec: dict, key: str) -> Column:
    """The condition of the one matching row of the lowest identifier."""
    low = find(df, spec).agg(F.min(key).alias("_low"))
    value = low.first()["_low"]
    return F.lit(False) if value is None else (F.col(key) == F.lit(value)) & compile_filter(spec, df.schema)


def update_many(df: DataFrame, spec: dict, update: dict, **options) -> DataFrame:
    return apply_update(df, update, compile_filter(spec, df.schema), **options)


def update_one(df: DataFrame, spec: dict, update: dict, *, key: str = "_id", upsert: bool = False, new_id: Any = None, now: Any = None) -> DataFrame:
    """The first match updated; with ``upsert`` and no match, a new row seeded from the filter's equalities."""
    if upsert and find(df, spec).isEmpty():
        seed = {k: v for k, v in spec.items() if not k.startswith("$") and not isinstance(v, dict)}
        seed.setdefault(key, new_id)
        fields = [F.lit(seed[f.name]).cast(f.dataType).alias(f.name) if f.name in seed else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        row = df.sparkSession.range(1).select(*fields)
        return df.unionByName(apply_update(row, update, key=key, now=now) if any(k.startswith("$") for k in update) else apply_update(row, update, key=key), allowMissingColumns=True)
    return apply_update(df, update, _first(df, spec, key), key=key, now=now)


def find_one_and_update(df: DataFrame, spec: dict, update: dict, *, key: str = "_id", return_new: bool = True, now: Any = None) -> tuple[DataFrame, DataFrame]:
    """(the row before or after, all rows after)."""
    hit = _first(df, spec, key)
    old = df.where(hit)
    return (apply_update(old, update, key=key, now=now) if return_new else old), apply_update(df, update, hit, key=key, now=now)


def upsert(df: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of ``rows`` replace those of the same key and are added where there are none."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_many(df: DataFrame, spec: dict) -> DataFrame:
    return df.where(~compile_filter(spec, df.schema))


def delete_one(df: DataFrame, spec: dict, *, key: str = "_id") -> DataFrame:
    return df.where(~_first(df, spec, key))


def trash(df: DataFrame, spec: dict, when: Any) -> DataFrame:
    """The rows a deletion takes, with the time of deletion."""
    return find(df, spec).withColumn("_deletedAt", F.lit(when))


def restore(df: DataFrame, bin_: DataFrame, spec: dict) -> DataFrame:
    """The table with the trashed rows that match put back."""
    return df.unionByName(find(bin_, spec).drop("_deletedAt"), allowMissingColumns=True)


def list_trash(bin_: DataFrame, most: int = 100, key: str = "_id") -> DataFrame:
    return bin_.orderBy(F.desc_nulls_last("_deletedAt"), key).limit(most)


def evict(bin_: DataFrame, *, before: Any = None, most: int | None = None, most_bytes: int | None = None, size: str | None = None, key: str = "_id") -> DataFrame:
    """Trash within the limits: not older than ``before``, the newest ``most``, the newest that fit ``most_bytes``."""
    if before is not None:
        bin_ = bin_.where(F.col("_deletedAt") >= F.lit(before))
    newest = Window.orderBy(F.desc("_deletedAt"), key)
    if most is not None:
        bin_ = keep_newest(bin_, "_deletedAt", most, key)
    if most_bytes is not None:
        bin_ = bin_.withColumn("_sum", F.sum(size or "bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= most_bytes).drop("_sum")
    return bin_


def keep_newest(df: DataFrame, time: str, most: int, key: str = "_id", by: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows, in all (a top-k, no global window) or per group."""
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(time), F.col(key).desc())
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return df.orderBy(F.desc_nulls_last(time), F.col(key).desc()).limit(most)


def ttl_purge(df: DataFrame, time: str, ttl: str | int, now: Any) -> DataFrame:
    """Rows not older than ``ttl``; rows without a time stay."""
    from ..functions.scalars import interval_ms

    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(time).cast("timestamp"))
    return df.where(F.coalesce(age <= interval_ms(ttl), F.lit(True)))


def lifecycle(df: DataFrame, time: str, *, ttl: str | int | None = None, most: int | None = None, now: Any = None, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """(kept, archived): expiry first, then the newest ``most``."""
    kept = ttl_purge(df, time, ttl, now) if ttl is not None else df
    if most is not None:
        kept = keep_newest(kept, time, most, key)
    return kept, df.join(kept.select(key), key, "left_anti")


def with_timestamps(df: DataFrame, now: Any) -> DataFrame:
    """createdAt where absent, updatedAt always."""
    when = F.lit(now)
    created = F.coalesce(F.col("createdAt"), when) if "createdAt" in df.columns else when
    return df.withColumns({"createdAt": created, "updatedAt": when})


def insert(df: DataFrame, rows: DataFrame, *, key: str = "_id", unique: list[str] | None = None) -> DataFrame:
    """Appended rows, with identifiers where absent; duplicate unique keys raise."""
    from .schema import DuplicateKeyError, unique_violations

    if key not in rows.columns:
        rows = rows.withColumn(key, F.expr("uuid()"))
    out = df.unionByName(rows, allowMissingColumns=True)
    if unique and not unique_violations(out, unique).isEmpty():
        raise DuplicateKeyError(f"duplicate key in {unique}")
    return out


def bulk_write(df: DataFrame, operations: list[dict], *, key: str = "_id", ordered: bool = True) -> tuple[DataFrame, dict]:
    """insertOne, updateOne, updateMany, replaceOne, deleteOne, deleteMany in order, with counters."""
    done = {"inserted": 0, "modified": 0, "upserted": 0, "deleted": 0, "errors": []}
    spark = df.sparkSession
    for i, operation in enumerate(operations):
        ((name, spec),) = operation.items()
        try:
            if name == "insertOne":
                document = spec.get("document", spec)
                fields = {f.name: f for f in df.schema.fields}
                row = spark.range(1).select(*((literal(v).cast(fields[k].dataType) if k in fields else literal(v)).alias(k) for k, v in document.items()))
                df = insert(df, row, key=key)
                done["inserted"] += 1
            elif name in ("updateOne", "updateMany", "replaceOne"):
                change = spec.get("update", spec.get("replacement"))
                hits = find(df, spec["filter"]).count()
                if hits or not spec.get("upsert"):
                    df = update_many(df, spec["filter"], change, key=key) if name == "updateMany" else update_one(df, spec["filter"], change, key=key)
                    done["modified"] += hits if name == "updateMany" else min(hits, 1)
                else:
                    df = update_one(df, spec["filter"], change, key=key, upsert=True)
                    done["upserted"] += 1
            elif name in ("deleteOne", "deleteMany"):
                hits = find(df, spec["filter"]).count()
                df = delete_many(df, spec["filter"]) if name == "deleteMany" else delete_one(df, spec["filter"], key=key)
                done["deleted"] += hits if name == "deleteMany" else min(hits, 1)
            else:
                raise UpdateError(f"unknown bulk operation {name}")
        except Exception as e:
            done["errors"].append({"index": i, "message": str(e)})
            if ordered:
                break
    return df, done


def counter(events: DataFrame, name: str = "name", delta: str = "delta") -> DataFrame:
    """Counter values as sums of their changes."""
    return events.groupBy(name).agg(F.sum(delta).alias("value"))


def dequeue(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The pending jobs to run next: highest priority, then oldest."""
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("createdAt"), F.asc("_id")).limit(n)


def acknowledge(jobs: DataFrame, ids: list) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("_id").isin(ids), "done").otherwise(F.col("status")))


def fail(jobs: DataFrame, ids: list, most: int = 3) -> DataFrame:
    """Failed jobs go back to pending until they have had ``most`` attempts."""
    hit = F.col("_id").isin(ids)
    attempts = F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))
    return jobs.withColumn("status", F.when(hit, F.when(F.col("attempts") + 1 >= most, "failed").otherwise("pending")).otherwise(F.col("status"))).withColumn("attempts", attempts)


def depth(jobs: DataFrame) -> int:
    return jobs.where("status = 'pending'").count()
