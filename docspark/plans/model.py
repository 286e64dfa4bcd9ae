"""Models: a schema, virtual columns, hooks and statics around a collection; migrations and a tool registry."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row

from ..operators import schema as rules
from ..operators import updates
from ..operators.query import Collection, Query

Change = Callable[[DataFrame], DataFrame]


class Plugins:
    """Hooks by moment: beforeInsert, afterInsert, beforeUpdate, afterUpdate."""

    def __init__(self) -> None:
        self.hooks: dict[str, list[Change]] = {}

    def on(self, moment: str, hook: Change) -> Change:
        self.hooks.setdefault(moment, []).append(hook)
        return hook

    def run(self, moment: str, df: DataFrame) -> DataFrame:
        for hook in self.hooks.get(moment, []):
            df = hook(df) or df
        return df


class Model:
    def __init__(self, df: DataFrame, *, key: str = "_id", schema: dict[str, dict] | None = None, virtuals: dict[str, Callable[[DataFrame], Column]] | None = None, plugins: Plugins | None = None, unique: list[str] | None = None):
        self.df, self.key, self.schema, self.virtuals = df, key, schema or {}, virtuals or {}
        self.plugins, self.unique = plugins or Plugins(), unique

    def _view(self) -> Collection:
        df = self.df
        for name, make in self.virtuals.items():
            df = df.withColumn(name, make(df))
        return Collection(df, self.key)

    def create(self, rows: DataFrame) -> DataFrame:
        """Validated and appended rows; rows that break a rule raise."""
        rows = self.plugins.run("beforeInsert", rules.with_defaults(rows, self.schema))
        bad = rules.violations(rows, self.schema)
        first = bad.first()
        if first is not None:
            raise ValueError(f"invalid document: {first['_violations']}")
        self.df = updates.insert(self.df, rows, key=self.key, unique=self.unique)
        self.plugins.run("afterInsert", rows)
        return rows

    def find(self, spec: dict | None = None) -> Query:
        return self._view().find(spec)

    def find_one(self, spec: dict | None = None) -> Row | None:
        return self._view().find_one(spec)

    def find_by_id(self, value: Any) -> Row | None:
        return self._view().find_by_id(value)

    def count_documents(self, spec: dict | None = None) -> int:
        return self._view().count(spec)

    def _updated(self, change: Change) -> DataFrame:
        self.df = change(self.plugins.run("beforeUpdate", self.df))
        self.plugins.run("afterUpdate", self.df)
        return self.df

    def update_one(self, spec: dict, update: dict, **options) -> DataFrame:
        return self._updated(lambda df: updates.update_one(df, spec, update, key=self.key, **options))

    def update_many(self, spec: dict, update: dict) -> DataFrame:
        return self._updated(lambda df: updates.update_many(df, spec, update, key=self.key))

    def delete_one(self, spec: dict) -> DataFrame:
        self.df = updates.delete_one(self.df, spec, key=self.key)
        return self.df

    def delete_many(self, spec: dict) -> DataFrame:
        self.df = updates.delete_many(self.df, spec)
        return self.df


class Migrations:
    """Numbered changes with their inverses."""

    def __init__(self) -> None:
        self.steps: dict[int, tuple[Change, Change | None]] = {}

    def add(self, version: int, up: Change, down: Change | None = None) -> None:
        self.steps[version] = (up, down)

    def up(self, df: DataFrame, version: int = 0, to: int | None = None) -> tuple[DataFrame, int]:
        for v in sorted(self.steps):
            if version < v <= (to if to is not None else v):
                df, version = self.steps[v][0](df), v
        return df, version

    def rollback(self, df: DataFrame, version: int, to: int = 0) -> tuple[DataFrame, int]:
        for v in sorted(self.steps, reverse=True):
            if to < v <= version:
                down = self.steps[v][1]
                if down is None:
                    raise ValueError(f"migration {v} can't be rolled back")
                df, version = down(df), max([u for u in self.steps if u < v], default=0)
        return df, version


class Tools:
    """Named queries with a description, for callers that choose by name."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def register(self, name: str, description: str, run: Callable[..., DataFrame]) -> None:
        self.tools[name] = (description, run)

    def register_collection(self, name: str, df: DataFrame, key: str = "_id", most: int = 5) -> None:
        """Equality and range filters on a collection, ``most`` rows."""
        self.register(f"query_{name}", f"rows of {name}", lambda spec=None, limit=most: Collection(df, key).find(spec).limit(limit).to_df())

    def call(self, name: str, **arguments) -> DataFrame:
        return self.tools[name][1](**arguments)
