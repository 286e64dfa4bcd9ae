"""Commands: one document in, a result out, over a set of named collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..operators import updates
from ..operators.filters import find, literal
from ..operators.pipeline import aggregate
from ..operators.query import Collection, parse_projection, paginate, project

FIRST_BATCH = 101


class Session:
    """Collections by name.  Mutating commands stage a new DataFrame under the name; ``commit`` or ``abort`` ends it."""

    def __init__(self, collections: dict[str, DataFrame], key: str = "_id"):
        self.collections, self.key = dict(collections), key
        self._committed = dict(collections)
        self._cursors: dict[int, tuple] = {}

    def commit(self) -> None:
        self._committed = dict(self.collections)

    def abort(self) -> None:
        self.collections = dict(self._committed)

    def run(self, command: dict) -> dict[str, Any]:
        """find, getMore, count, aggregate, insert, update, delete, createIndexes, explain and the action forms."""
        name = next(iter(command))
        if name == "action":
            return self._action(command)
        target = command[name]
        handler = getattr(self, f"_{name}", None)
        if handler is None:
            return {"ok": 0, "errmsg": f"no such command: {name}"}
        return {"ok": 1} | handler(target, command)

    def _find(self, target: str, c: dict) -> dict:
        q = Collection(self.collections[target], self.key).find(c.get("filter"))
        q = q.sort(c["sort"]) if c.get("sort") else q
        q = q.skip(c.get("skip", 0)).limit(c.get("limit", 0))
        df = project(q.to_df(), parse_projection(c.get("projection")), None)
        if c.get("batchSize") is None or self.key not in df.columns or c.get("sort") or c.get("skip") or c.get("limit"):
            return {"cursor": {"id": 0, "firstBatch": df}}
        page = paginate(df, self.key, self.key, size=c["batchSize"] or FIRST_BATCH)
        number = len(self._cursors) + 1 if page["hasMore"] else 0
        if number:
            self._cursors[number] = (df, page["nextCursor"])
        return {"cursor": {"id": number, "firstBatch": page["docs"]}}

    def _getMore(self, number: int, c: dict) -> dict:  # noqa: N802
        df, at = self._cursors.pop(number)
        page = paginate(df, self.key, self.key, size=c.get("batchSize", FIRST_BATCH), cursor=at)
        if page["hasMore"]:
            self._cursors[number] = (df, page["nextCursor"])
        return {"cursor": {"id": number if page["hasMore"] else 0, "nextBatch": page["docs"]}}

    def _count(self, target: str, c: dict) -> dict:
        return {"n": find(self.collections[target], c.get("query") or c.get("filter")).count()}

    def _aggregate(self, target: str, c: dict) -> dict:
        return {"cursor": {"id": 0, "firstBatch": aggregate(self.collections[target], c["pipeline"], self.collections, key=self.key)}}

    def _insert(self, target: str, c: dict) -> dict:
        df = self.collections[target]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for document in c["documents"]:
            row = df.sparkSession.range(1).select(*((literal(v).cast(kinds[k]) if k in kinds else literal(v)).alias(k) for k, v in document.items()))
            df = updates.insert(df, row, key=self.key)
        self.collections[target] = df
        return {"n": len(c["documents"])}

    def _update(self, target: str, c: dict) -> dict:
        n = 0
        for u in c["updates"]:
            df = self.collections[target]
            hits = find(df, u["q"]).count()
            many = bool(u.get("multi"))
            self.collections[target] = updates.update_many(df, u["q"], u["u"], key=self.key) if many else updates.update_one(df, u["q"], u["u"], key=self.key, upsert=bool(u.get("upsert")))
            n += hits if many else min(hits, 1)
        return {"n": n, "nModified": n}

    def _delete(self, target: str, c: dict) -> dict:
        n = 0
        for d in c["deletes"]:
            df = self.collections[target]
            hits = find(df, d["q"]).count()
            one = d.get("limit") == 1
            self.collections[target] = updates.delete_one(df, d["q"], key=self.key) if one else updates.delete_many(df, d["q"])
            n += min(hits, 1) if one else hits
        return {"n": n}

    def _createIndexes(self, target: str, c: dict) -> dict:  # noqa: N802
        """Indexes are layout: the collection is kept sorted within partitions by the first index's keys."""
        keys = [k for k in c["indexes"][0]["key"] if k in self.collections[target].columns]
        self.collections[target] = self.collections[target].sortWithinPartitions(*keys) if keys else self.collections[target]
        return {"numIndexesAfter": len(c["indexes"]) + 1}

    def _explain(self, target: str, c: dict) -> dict:
        return Collection(self.collections[target], self.key).find(c.get("filter")).explain()

    def _action(self, c: dict) -> dict:
        action, target, body = c["action"], c["collection"], c
        if action == "insertOne":
            return self.run({"insert": target, "documents": [body["document"]]})
        if action == "find":
            return self.run({"find": target, "filter": body.get("query")})
        if action == "count":
            return self.run({"count": target, "query": body.get("query")})
        if action == "updateOne":
            return self.run({"update": target, "updates": [{"q": body["query"], "u": body["update"]}]})
        if action == "deleteOne":
            return self.run({"delete": target, "deletes": [{"q": body["query"], "limit": 1}]})
        if action == "explain":
            return self.run({"explain": target, "filter": body.get("query")})
        return {"ok": 0, "errmsg": f"no such action: {action}"}


def run_command(collections: dict[str, DataFrame], command: dict, key: str = "_id") -> dict[str, Any]:
    """One command over collections that it doesn't change."""
    return Session(collections, key).run(command)
