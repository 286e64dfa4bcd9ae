"""SQL, GraphQL, natural language, commands, models, sources and streams."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docspark.plans import commands, graphql, nlq, sqlfront
from docspark.plans.model import Migrations, Model, Plugins, Tools
from docspark.sources import readers, writers
from docspark.streaming import streams


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("1", "Alice", 30, 95), ("2", "Bob", 20, 80), ("3", "Charlie", 35, 90), ("4", "Dora", None, None)], "_id string, name string, age int, score int")


def names(df):
    return [r["name"] for r in df.collect()]


def test_sql(spark, people):
    run = lambda q: sqlfront.execute(spark, q, {"people": people})
    assert names(run("SELECT * FROM people WHERE age >= 25 ORDER BY score DESC LIMIT 2")) == ["Alice", "Charlie"]
    assert names(run("SELECT name FROM people WHERE name LIKE '%LI%' ORDER BY name")) == ["Alice", "Charlie"]
    assert names(run("SELECT name FROM people ORDER BY age"))[-1] == "Dora" == names(run("SELECT name FROM people ORDER BY age DESC"))[-1]
    assert sqlfront.execute(spark, "SELECT name FROM people WHERE name LIKE 'A%'", {"people": people}, compatible=False).count() == 1


def test_graphql(people):
    out = graphql.execute('query { people(limit: 1, sort: "-age", where: {age: {gte: 30}}) { name nope } }', {"people": people})["people"]
    assert out.columns == ["name"] and names(out) == ["Charlie"]
    assert graphql.execute("{ people { _id } people { name } }", {"people": people})["people"].columns == ["name"]
    for bad in ("{ nobody { a } }", "{ people { a ", "{ people(limit: ?) }"):
        with pytest.raises(graphql.GraphQLError):
            graphql.execute(bad, {"people": people})


@pytest.mark.parametrize("prompt, fields, spec", [
    ("Users with age > 25 and active status", ["age", "status"], {"age": {"$gt": 25}, "status": "active"}), ("المستخدمين الذين عمرهم أكبر من ٢٥ وحالتهم نشط", ["age", "status"], {"age": {"$gt": 25}, "status": "active"}),
    ("Utilisateurs avec age > 30 et statut actif", ["age", "status"], {"age": {"$gt": 30}, "status": "active"}), ("Usuarios con edad entre 18 y 65", ["edad"], {"edad": {"$gte": 18, "$lte": 65}}),
    ("查找 age > 20 的活跃用户", ["age", "status"], {"age": {"$gt": 20}, "status": "active"}), ("Пользователи с балансом больше 500 и статус активный", ["balance", "status"], {"balance": {"$gt": 500}, "status": "active"}),
    ("inactive users with score >= 5", ["score"], {"status": "inactive", "score": {"$gte": 5}}), ("role is admin", ["role"], {"role": "admin"}), ("vip customers", [], {"isVIP": True}), ("", [], {}),
])
def test_prompts(prompt, fields, spec):
    assert nlq.parse(prompt, fields).filter == spec


def test_prompt_limits(people):
    p = nlq.parse("Top 10 Benutzer mit Gehalt > 5000", ["salary"])
    assert (p.filter, p.sort, p.limit) == ({"salary": {"$gt": 5000}}, {"salary": -1}, 10)
    assert names(nlq.query(people, "top 2 by score").to_df()) == ["Alice", "Charlie"]
    asked = nlq.parse_with("x", [], lambda _: json.dumps({"filter": {"a": 1}, "limit": 3}))
    assert asked.filter == {"a": 1} and asked.limit == 3 and nlq.parse_with("age > 3", ["age"], lambda _: "no json").filter == {"age": {"$gt": 3}}


def test_commands(people):
    s = commands.Session({"p": people})
    assert s.run({"count": "p", "query": {"age": {"$gt": 25}}})["n"] == 2
    assert s.run({"insert": "p", "documents": [{"_id": "9", "name": "Zed", "age": 1}]})["n"] == 1 and s.run({"count": "p"})["n"] == 5
    assert s.run({"update": "p", "updates": [{"q": {"name": "Zed"}, "u": {"$inc": {"age": 1}}}]})["nModified"] == 1
    first = s.run({"find": "p", "batchSize": 2})["cursor"]
    more = s.run({"getMore": first["id"], "batchSize": 9})["cursor"]
    assert [r["_id"] for r in first["firstBatch"] + more["nextBatch"]] == ["1", "2", "3", "4", "9"] and more["id"] == 0
    assert s.run({"delete": "p", "deletes": [{"q": {"age": {"$lt": 25}}, "limit": 0}]})["n"] == 2
    s.abort()
    assert s.run({"count": "p"})["n"] == 4 and s.run({"nope": "p"})["ok"] == 0
    assert s.run({"action": "find", "collection": "p", "query": {"name": "Bob"}})["cursor"]["firstBatch"].count() == 1
    assert s.run({"createIndexes": "p", "indexes": [{"key": {"age": 1}}]})["numIndexesAfter"] == 2 and s.run({"explain": "p", "filter": {}})["stage"] == "FULL_SCAN"


def test_model(people):
    plugins = Plugins()
    plugins.on("beforeInsert", lambda df: df.withColumn("name", F.upper("name")))
    model = Model(people, schema={"age": {"min": 0}}, virtuals={"adult": lambda df: F.col("age") >= 18}, plugins=plugins)
    row = people.limit(1).select(F.lit("7").alias("_id"), F.lit("eve").alias("name"), F.lit(5).alias("age"), F.lit(1).alias("score"))
    model.create(row)
    assert model.find({"adult": False}).first()["name"] == "EVE" and model.count_documents() == 5
    with pytest.raises(ValueError):
        model.create(row.withColumn("age", F.lit(-1)))
    model.update_one({"_id": "7"}, {"$set": {"age": 20}})
    model.delete_many({"adult": True} if False else {"age": {"$gte": 30}})
    assert model.count_documents() == 3 and model.find_by_id("7")["age"] == 20
    steps = Migrations()
    steps.add(1, lambda df: df.withColumn("a", F.lit(1)), lambda df: df.drop("a"))
    steps.add(2, lambda df: df.withColumn("b", F.lit(2)), lambda df: df.drop("b"))
    df, version = steps.up(people)
    assert version == 2 and {"a", "b"} <= set(df.columns) and steps.rollback(df, 2, 1)[0].columns == [*people.columns, "a"]
    tools = Tools()
    tools.register_collection("people", people)
    assert tools.call("query_people", spec={"age": {"$gt": 20}}).count() == 2


def test_files(spark, people, tmp_path):
    (tmp_path / "in.ndjson").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    assert readers.ndjson(spark, str(tmp_path / "in.ndjson"), schema="a int").count() == 2
    assert readers.documents(spark, str(tmp_path / "in.ndjson")).count() == 2
    with pytest.raises(Exception):
        readers.ndjson(spark, str(tmp_path / "in.ndjson"), mode="fail", schema="a int").collect()
    nested = people.withColumn("tags", F.array(F.lit('say "x"'), F.lit("b")))
    writers.write_csv(nested, str(tmp_path / "csv"), ["_id", "age", "tags"])
    back = {r["_id"]: (r["age"], r["tags"]) for r in readers.csv(spark, str(tmp_path / "csv")).collect()}
    assert back["1"] == ("30", '["say \\"x\\"","b"]') and back["4"][0] in ("", None)
    path = writers.write_bundle({"people": people}, str(tmp_path / "bundles"), name="b1")
    assert readers.latest_bundle(str(tmp_path / "bundles")) == path and writers.read_bundle(spark, path)["people"].count() == 4
    blobs = spark.createDataFrame([("x", b"abcabcab"), ("y", b"")], "k string, data binary")
    refs, chunks = writers.blob_chunks(blobs, key="k", data="data", size=3)
    assert refs.count() == 3 and chunks.count() == 2
    assert bytes(writers.blob_restore(refs, chunks, key="k").first()["data"]) == b"abcabcab"
    assert readers.generate_users(spark, 50).collect() == readers.generate_users(spark, 50).collect()
    assert {r["field"]: r["present"] for r in writers.field_presence(people).collect()} == {"_id": 4, "name": 4, "age": 3, "score": 3}


def test_ring_search_hashes_each_key_once(spark):
    for nodes, virtual in ((["a"], 1), (["a", "b"], 1), (["n1", "n2", "n3"], 64), ([f"n{i}" for i in range(17)], 5)):
        points = writers.ring(nodes, virtual)
        df = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("id")).select("id", writers.shard_of(F.col("id"), nodes, virtual).alias("n"))
        for r in df.collect():
            h = -1 if r["id"] is None else int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:8], 16)
            assert r["n"] == next((n for p, n in points if p >= h), points[0][1])
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_ring(spark):
    points = writers.ring(["a", "b"], 4)
    df = spark.range(200).select(F.col("id"), writers.shard_of(F.col("id"), ["a", "b"], 4).alias("n"))
    import hashlib

    for r in df.collect():
        h = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:8], 16)
        assert r["n"] == next((n for p, n in points if p >= h), points[0][1])


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "seq long, op string, id long, ts timestamp, v int"
    for k, rows in enumerate([[(1, "insert", 1, at(0), 5), (2, "update", 1, at(1), 6)], [(3, "insert", 2, at(30), 7)], [(5, "update", 2, at(31), 9)], [(4, "insert", 3, at(2), 8)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = lambda: streams.read_stream(spark, str(tmp_path / "in" / "*"), schema, files=1)
    seen = streams.drain_to_memory(streams.watch(source(), {"v": {"$gt": 5}}, ["insert"]), "changes")
    assert sorted(r["id"] for r in seen.collect()) == [2, 3]
    windows = streams.tumbling(source(), "ts", "10 minutes", [F.count(F.lit(1)).alias("n")], late="5 minutes")
    streams.drain(windows, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r["windowStart"].minute, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 2)]  # the late row is dropped
    streams.drain(windows, str(tmp_path / "out"), str(tmp_path / "state"))  # the checkpoint resumes: nothing twice
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    calls = spark.createDataFrame([("u", t) for t in (0, 1, 2, 3, 60_000)], "u string, ms long")
    assert [r["allowed"] for r in streams.rate_limit(calls, "u", "ms", capacity=2, refill=1).orderBy("ms").collect()] == [True, True, False, False, True]
