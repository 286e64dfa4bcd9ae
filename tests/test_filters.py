"""Filters: known examples, null handling, and random filters against a Python evaluator."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.operators.filters import FilterError, compile_filter, find
from docspark.operators.query import Collection, decode_cursor

PEOPLE = [("1", "Alexander Turing", 28, 1500, "active"), ("2", "Sarah Connor", 34, 3200, "active"), ("3", "John Doe", 45, 800, "suspended"), ("4", "Alex Johnson", 22, 2100, "active"), ("5", None, None, None, None)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "_id string, name string, age int, balance int, status string")


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize("spec, want", [
    ({}, "12345"), ({"name": "John Doe"}, "3"), ({"age": None}, "5"), ({"missing": None}, "12345"), ({"missing": 1}, ""), ({"age": {"$ne": 28}}, "2345"), ({"age": {"$gte": 30}}, "23"),
    ({"age": {"$gt": "30"}}, "23"), ({"age": "28"}, ""), ({"age": {"$nin": [28, 34]}}, "345"), ({"age": {"$in": [28, None]}}, "15"), ({"age": {"$exists": False}}, "5"), ({"age": {"$type": "number"}}, "1234"),
    ({"age": {"$not": {"$gt": 30}}}, "145"), ({"$nor": [{"age": {"$gt": 30}}, {"status": "active"}]}, "5"), ({"$or": []}, ""), ({"$and": []}, "12345"), ({"$and": 3}, ""),
    ({"name": re.compile("^Alex")}, "14"), ({"name": {"$regex": "alex"}}, "14"), ({"name": {"$regex": "alex", "$options": ""}}, ""), ({"age": {"$mod": [2, 0]}}, "124"), ({"age": {"$mod": [0, 0]}}, ""),
    ({"name": {"$fuzzy": "Sara"}}, "2"), ({"name": {"$fuzzy": "Alexandr Turin", "maxDistance": 2}}, "1"), ({"name": {"$soundex": "Tuuring"}}, "1"), ({"$ids": ["2", "9"]}, "2"),
    ({"age": {"$size": 1}}, ""), ({"age": {"$elemMatch": {"$gt": 1}}}, ""), ({"status": {"$gt": 5}}, ""),
])
def test_examples(people, spec, want):
    assert ids(find(people, spec)) == list(want)
    negated = people.where(~compile_filter(spec, people.schema))
    assert ids(negated) == sorted(set("12345") - set(want))


def test_unknown_operators_raise(people):
    for spec in ({"age": {"$near": 1}}, {"$xor": []}):
        with pytest.raises(FilterError):
            find(people, spec)


def test_nan_is_not_greater(spark):
    df = spark.createDataFrame([("1", float("nan")), ("2", 5.0), ("3", None)], "_id string, x double")
    assert ids(find(df, {"x": {"$gt": 1}})) == ["2"] and ids(find(df, {"x": {"$lte": 9}})) == ["2"]


def test_arrays_and_nested(spark):
    df = spark.createDataFrame([("1", [1, 2, 2], [("a", 5)], ((1,),)), ("2", [], [("b", 1), ("a", 1)], ((2,),)), ("3", None, None, None)], "_id string, a array<int>, s array<struct<k:string,v:int>>, n struct<m:struct<x:int>>")
    for spec, want in (
        ({"a": [1, 2, 2]}, "1"), ({"a": []}, "2"), ({"a": {"$size": 0}}, "2"), ({"a": {"$all": [2, 1]}}, "1"), ({"a": {"$all": []}}, "12"), ({"a": {"$in": [2, 9]}}, "1"), ({"a": {"$nin": [2]}}, "23"),
        ({"s": {"$elemMatch": {"k": "a", "v": {"$gt": 2}}}}, "1"), ({"s": {"$elemMatch": {"$or": [{"v": 5}, {"k": "b"}]}}}, "12"), ({"n.m.x": 2}, "2"), ({"n.m.y": 2}, ""), ({"n": {"m": {"x": 1}}}, "1"), ({"a.0": 1}, "1"), ({"s.1.k": "a"}, "2"),
    ):
        assert ids(find(df, spec)) == list(want), spec


def test_variant(spark):
    docs = [("1", '{"a": 1, "b": {"c": "x"}, "t": [1, 2]}'), ("2", '{"a": null, "b": {"c": 5}}'), ("3", '{"b": true}')]
    df = spark.createDataFrame(docs, "_id string, j string").select("_id", F.parse_json("j").alias("d"))
    for spec, want in (({"d.a": 1}, "1"), ({"d.a": None}, "23"), ({"d.a": {"$exists": True}}, "12"), ({"d.b.c": "x"}, "1"), ({"d.b.c": {"$gt": 3}}, "2"), ({"d.a": {"$type": "undefined"}}, "3"), ({"d.t": {"$type": "array"}}, "1"), ({"d.b": True}, "3"), ({"d.a": "1"}, ""), ({"d.t.1": 2}, "1")):
        assert ids(find(df, spec)) == list(want), spec


def test_times(spark):
    at = datetime.datetime(2024, 1, 2)
    df = spark.createDataFrame([("1", at), ("2", datetime.datetime(2024, 3, 1))], "_id string, t timestamp_ntz")
    assert ids(find(df, {"t": {"$gt": "2024-02-01"}})) == ["2"] and ids(find(df, {"t": at})) == ["1"] and ids(find(df, {"t": "2024-01-02 00:00:00"})) == ["1"]


def evaluate(row, spec):
    def one(v, c):
        if not (isinstance(c, dict) and any(k.startswith("$") for k in c)):
            return v == c if c is not None else v is None
        for op, x in c.items():
            ok = {"$eq": lambda: v == x, "$ne": lambda: v != x, "$gt": lambda: v is not None and v > x, "$gte": lambda: v is not None and v >= x, "$lt": lambda: v is not None and v < x, "$lte": lambda: v is not None and v <= x, "$in": lambda: v in x, "$nin": lambda: v not in x, "$exists": lambda: (v is not None) == x, "$mod": lambda: v is not None and v % x[0] == x[1], "$not": lambda: not one(v, x)}[op]()
            if not ok:
                return False
        return True

    for k, c in spec.items():
        if k == "$and" and not all(evaluate(row, s) for s in c) or k == "$or" and not any(evaluate(row, s) for s in c) or k == "$nor" and any(evaluate(row, s) for s in c):
            return False
        if not k.startswith("$") and not one(row[k], c):
            return False
    return True


def random_filter(rng, depth=0):
    if depth < 2 and rng.random() < 0.4:
        return {rng.choice(["$and", "$or", "$nor"]): [random_filter(rng, depth + 1) for _ in range(rng.randint(0, 3))]}
    n = lambda: rng.randint(0, 6)

    def cond(deep=0):
        op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$mod", "$not"] if deep < 2 else ["$gt", "$eq"])
        value = {"$in": lambda: [n(), n(), None][: rng.randint(0, 3)], "$nin": lambda: [n(), None][: rng.randint(0, 2)], "$exists": lambda: rng.random() < 0.5, "$mod": lambda: [rng.randint(1, 3), rng.randint(0, 2)], "$not": lambda: cond(deep + 1)}.get(op, n)()
        return {op: value}

    return {rng.choice("xyz"): rng.choice([n(), None, cond(), cond()]) for _ in range(rng.randint(0, 2))}


def test_random_filters_match_an_evaluator(spark):
    rng = random.Random(7)
    rows = [(i, *(rng.choice([None, 0, 1, 2, 3, 4, 5, 6]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x int, y int, z int").cache()
    specs = [random_filter(rng) for _ in range(120)]
    got = df.select("i", *(compile_filter(s, df.schema).alias(f"f{k}") for k, s in enumerate(specs))).collect()
    for r in got:
        row = dict(zip(("i", "x", "y", "z"), rows[r["i"]]))
        for k, s in enumerate(specs):
            assert r[f"f{k}"] is evaluate(row, s), (row, s)


# The builder.
PRODUCTS = [("1", "Laptop Pro", 1200, 4.5), ("2", "Mouse", 25, 4.2), ("3", "Mechanical Keyboard", 90, 4.7), ("4", "USB Cable", 40, 3.9), ("5", "Ergonomic Chair", 350, 4.8)]


@pytest.fixture(scope="module")
def products(spark):
    return Collection(spark.createDataFrame(PRODUCTS, "_id string, name string, price int, rating double"))


def names(rows):
    return [r["name"] for r in rows]


def test_builder(products):
    assert names(products.find().sort("-price").limit(2).exec()) == ["Laptop Pro", "Ergonomic Chair"]
    assert names(products.find().where("price").lt(100).sort({"price": 1}).exec()) == ["Mouse", "USB Cable", "Mechanical Keyboard"]
    assert names(products.find().sort("price").skip(2).limit(2).exec()) == ["Mechanical Keyboard", "Ergonomic Chair"]
    assert products.find().where("price").gte(40).where("rating").gt(4.6).count_documents() == 2
    assert products.find({"price": 25}).select("name").to_df().columns == ["_id", "name"]
    assert products.find({"price": 25}).select({"name": 1, "_id": 0}).to_df().columns == ["name"]
    assert products.find({"price": 25}).select("-price -rating").to_df().columns == ["_id", "name"]
    assert names(products.find({"rating": {"$gt": 4.6}}).select("name").sort("name").exec()) == ["Ergonomic Chair", "Mechanical Keyboard"]
    assert products.find_by_id("4")["name"] == "USB Cable" and products.find_one({"price": {"$gt": 5000}}) is None
    assert sum(len(b) for b in products.find().stream(2)) == 5
    assert products.find().where("name").regex("^me").in_ is not None


def test_explain(products, spark, sf):
    orders = Collection(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey")
    plan = orders.find({"o_orderstatus": "F"}).select("o_totalprice").explain()
    assert "EqualTo(o_orderstatus,F)" in plan["pushedFilters"] and "o_orderdate" not in plan["readSchema"]
    assert orders.find({"o_orderkey": 3}).explain()["stage"] == "POINT_LOOKUP"


def test_pages(spark):
    items = Collection(spark.createDataFrame([(str(100 + i), i // 2 if i != 7 else None) for i in range(25)], "_id string, n int"))
    seen, cursor = [], None
    while True:
        page = items.find().page("n", 10, cursor)
        seen += [r["_id"] for r in page["docs"]]
        cursor = page["nextCursor"]
        if not page["hasMore"]:
            break
        assert set(decode_cursor(cursor)) == {"k", "v", "id"}
    assert len(seen) == 25 == len(set(seen)) and seen[0] == "107"
    down, cursor = [], None
    while True:
        page = items.find().page("n", 10, cursor, descending=True)
        down += [r["_id"] for r in page["docs"]]
        cursor = page["nextCursor"]
        if not page["hasMore"]:
            break
    assert down == seen[::-1]
