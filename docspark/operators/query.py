"""Collections and the lazy query builder.

A ``Collection`` wraps a DataFrame and the name of its identifier column; a
``Query`` gathers filter, order, skip, limit, projection and populate, and
``to_df`` compiles them: filter first, then joins, order, offset, limit and the
projection, so a filter may use fields that aren't selected.  Nothing is
limited unless asked.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import joins
from .filters import compile_filter, find, resolve


def parse_sort(spec: dict | str | list) -> list[tuple[str, bool]]:
    """(field, descending) pairs of {'a': -1}, '-a b' or [('a', -1)]."""
    if isinstance(spec, str):
        return [(w.lstrip("-+"), w.startswith("-")) for w in spec.split()]
    pairs = spec.items() if isinstance(spec, dict) else spec
    return [(k, v in (-1, "desc", "descending")) for k, v in pairs]


def parse_projection(spec: dict | str | list | None) -> dict[str, bool]:
    if spec is None:
        return {}
    if isinstance(spec, str):
        return {w.lstrip("-"): not w.startswith("-") for w in spec.split()}
    if isinstance(spec, (list, tuple)):
        return dict.fromkeys(spec, True)
    return {k: bool(v) for k, v in spec.items()}


def sort_columns(df: DataFrame, order: list[tuple[str, bool]], tie: str | None = None) -> list[Column]:
    """Sort keys, nulls last in both directions, with a final tie-break."""
    keys = []
    for path, descending in order:
        ref = resolve(df.schema, path)
        if ref.column is not None:
            keys.append(ref.column.desc_nulls_last() if descending else ref.column.asc_nulls_last())
    if tie and tie in df.columns and tie not in [p for p, _ in order]:
        keys.append(F.col(f"`{tie}`").asc_nulls_last())
    return keys


def project(df: DataFrame, spec: dict[str, bool], key: str | None = "_id") -> DataFrame:
    """Inclusive projections keep the identifier unless it is excluded; exclusive ones drop fields."""
    if not spec:
        return df
    wanted = [k for k, v in spec.items() if v]
    if not wanted:
        tops = [k for k in spec if "." not in k]
        df = df.drop(*tops)
        for path in (k for k in spec if "." in k):
            top, _, rest = path.partition(".")
            if top in df.columns:
                df = df.withColumn(top, F.col(f"`{top}`").dropFields(rest))
        return df
    if key and key in df.columns and key not in wanted and spec.get(key, True):
        wanted = [key, *wanted]
    columns = []
    for path in wanted:
        ref = resolve(df.schema, path)
        if ref.column is not None:
            columns.append((ref.as_type("string") if ref.path else ref.column).alias(path))
    return df.select(*columns)


@dataclass(frozen=True)
class Query:
    source: Collection
    filter: dict = field(default_factory=dict)
    order: tuple = ()
    skipped: int = 0
    most: int = 0
    projection: tuple = ()
    populated: tuple = ()
    _field: str | None = None

    # Conditions on one field: where("age").gte(30).where("city").equals("x")
    def where(self, name: str | dict) -> Query:
        if isinstance(name, dict):
            return replace(self, filter={"$and": [self.filter, name]} if self.filter else name)
        return replace(self, _field=name)

    def _with(self, op: str, value: Any) -> Query:
        if self._field is None:
            raise ValueError("where(field) comes first")
        one = {self._field: value if op == "$eq" else {op: value}}
        return replace(self, filter={"$and": [self.filter, one]} if self.filter else one)

    def equals(self, value: Any) -> Query:
        return self._with("$eq", value)

    def ne(self, value: Any) -> Query:
        return self._with("$ne", value)

    def gt(self, value: Any) -> Query:
        return self._with("$gt", value)

    def gte(self, value: Any) -> Query:
        return self._with("$gte", value)

    def lt(self, value: Any) -> Query:
        return self._with("$lt", value)

    def lte(self, value: Any) -> Query:
        return self._with("$lte", value)

    def in_(self, values: list) -> Query:
        return self._with("$in", values)

    def nin(self, values: list) -> Query:
        return self._with("$nin", values)

    def regex(self, pattern: Any) -> Query:
        return self._with("$regex", pattern)

    def sort(self, spec: dict | str | list) -> Query:
        return replace(self, order=tuple(parse_sort(spec)))

    def skip(self, n: int) -> Query:
        return replace(self, skipped=max(0, int(n)))

    def limit(self, n: int) -> Query:
        """At most n rows; 0 is no limit."""
        return replace(self, most=max(0, int(n)))

    def select(self, spec: dict | str | list) -> Query:
        return replace(self, projection=tuple(parse_projection(spec).items()))

    def populate(self, local: str, foreign: DataFrame | Collection, foreign_field: str = "_id", as_: str | None = None, single: bool = False) -> Query:
        other = foreign.df if isinstance(foreign, Collection) else foreign
        return replace(self, populated=(*self.populated, (local, other, foreign_field, as_ or local, single)))

    def lean(self) -> Query:
        return self

    def to_df(self) -> DataFrame:
        df = find(self.source.df, self.filter)
        for local, other, theirs, name, single in self.populated:
            df = joins.lookup(df, other, local, theirs, name, single=single)
        if self.order or self.skipped or self.most:
            keys = sort_columns(df, list(self.order), self.source.key if self.order else None)
            df = df.orderBy(*keys) if keys else df
            df = df.offset(self.skipped) if self.skipped else df
            df = df.limit(self.most) if self.most else df
        return project(df, dict(self.projection), self.source.key)

    def exec(self) -> list[Row]:
        return self.to_df().collect()

    def first(self) -> Row | None:
        rows = self.limit(1).exec()
        return rows[0] if rows else None

    def count_documents(self) -> int:
        return self.to_df().count()

    def stream(self, batch: int = 500) -> Iterator[list[Row]]:
        """Batches of rows without collecting them all."""
        held: list[Row] = []
        for row in self.to_df().toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == batch:
                yield held
                held = []
        if held:
            yield held

    def explain(self) -> dict:
        """What the plan does: stage, filters that reach the scan, columns read, and the plan itself."""
        df = self.to_df()
        plan = df._jdf.queryExecution().executedPlan().toString()
        key = self.source.key
        stage = "POINT_LOOKUP" if key in self.filter and not isinstance(self.filter[key], dict) else "FILTERED_SCAN" if self.filter else "FULL_SCAN"
        if len(self.filter) > 1 and all(not k.startswith("$") and not isinstance(v, dict) for k, v in self.filter.items()):
            stage = "COMPOUND_EQUALITY"
        grab = lambda mark: plan.partition(f"{mark}: ")[2].partition("\n")[0].split(", Read")[0] if f"{mark}: " in plan else ""
        return {"stage": stage, "pushedFilters": grab("PushedFilters"), "readSchema": grab("ReadSchema"), "plan": plan}

    def page(self, by: str, size: int = 10, cursor: str | None = None, descending: bool = False) -> dict:
        """Keyset page: docs, nextCursor, hasMore."""
        return paginate(find(self.source.df, self.filter), by, self.source.key, size=size, cursor=cursor, descending=descending)


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    key: str = "_id"
    name: str = ""

    def find(self, spec: dict | None = None) -> Query:
        return Query(self, spec or {})

    def find_one(self, spec: dict | None = None) -> Row | None:
        return self.find(spec).sort({self.key: 1}).first()

    def find_by_id(self, value: Any) -> Row | None:
        return self.find({self.key: value}).first()

    def find_ids(self, ids: list) -> DataFrame:
        return find(self.df, {self.key: {"$in": ids}})

    def count(self, spec: dict | None = None) -> int:
        return find(self.df, spec).count()

    def aggregate(self, stages: list[dict], collections: dict[str, DataFrame] | None = None) -> DataFrame:
        from .pipeline import aggregate

        return aggregate(self.df, stages, collections, key=self.key)

    def time_series_bucket(self, time: str, interval: str | int, aggregations: dict) -> DataFrame:
        from .timeseries import bucket

        return bucket(self.df, time, interval, aggregations)

    def near(self, point: tuple[float, float], **options) -> DataFrame:
        from .geo import near

        return near(self.df, point, **options)


def encode_cursor(key: str, value: Any, identifier: Any) -> str:
    """Opaque position of a row in a keyset order."""
    return base64.urlsafe_b64encode(json.dumps({"k": key, "v": value, "id": identifier}, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))


def after(df: DataFrame, by: str, key: str, value: Any, identifier: Any, descending: bool = False) -> Column:
    """Rows after a position; nulls come first ascending and last descending."""
    kind = df.schema[by].dataType
    k, i, v = F.col(by), F.col(key), F.lit(value).cast(kind)
    tied = i < F.lit(identifier) if descending else i > F.lit(identifier)
    if value is None:
        return (k.isNull() & tied) if descending else (k.isNull() & tied) | k.isNotNull()
    beyond = (k < v) | k.isNull() if descending else k > v
    return F.coalesce(beyond | ((k == v) & tied), F.lit(False))


def paginate(df: DataFrame, by: str, key: str = "_id", *, size: int = 10, cursor: str | None = None, descending: bool = False) -> dict:
    if cursor:
        at = decode_cursor(cursor)
        df = df.where(after(df, by, key, at["v"], at["id"], descending))
    order = [F.col(by).desc_nulls_last(), F.col(key).desc()] if descending else [F.col(by).asc_nulls_first(), F.col(key).asc()]
    rows = df.orderBy(*order).limit(size + 1).collect()
    docs, more = rows[:size], len(rows) > size
    return {"docs": docs, "hasMore": more, "nextCursor": encode_cursor(by, docs[-1][by], docs[-1][key]) if more else None}


def filter_column(df: DataFrame, spec: dict) -> Column:
    return compile_filter(spec, df.schema)
