"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from docspark.plans import registry
from docspark.sources.readers import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't check, with the test of their operator.
ELSEWHERE = {
    "near_dup_pages": "test_budget_and_duplicates", "token_budget": "test_budget_and_duplicates", "hash_embedding": "test_embedding_matches_a_naive_one", "rag_ask": "test_vectors", "hybrid_search": "test_vectors",
    "agent_recall": "test_vectors", "semantic_cache": "test_vectors", "private_sum": "test_privacy", "manifest": "test_merkle_and_chain", "generate_users": "test_files", "stream_rate_limit": "test_streams",
    "graph_shortest_path": "test_graph_matches_brute_force", "graph_cycle": "test_graph_matches_brute_force",
}
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert name in ELSEWHERE
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: kinds[c] for c, k in df.dtypes if k in KINDS} == {c: KINDS[k] for c, k in df.dtypes if k in KINDS}
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
