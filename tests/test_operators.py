"""Pipelines, joins, updates, schema, time, geography, graphs, text, vectors, history, privacy on known examples."""

import datetime
import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.functions import scalars
from docspark.operators import geo, graph, history, integrity, joins, privacy, schema, text, timeseries, updates, vectors
from docspark.operators.pipeline import PipelineError, aggregate


STARS = ("*" * 4 + "-") * 3


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# Scalars.
def test_scalars(spark):
    one = spark.range(1)
    ev = lambda c: one.select(c.alias("v")).first()["v"]
    for name, code in (("Robert", "R163"), ("Rupert", "R163"), ("Turing", "T652"), ("Ashcraft", "A226"), ("", ""), ("A", "A000"), ("Tymczak", "T522")):
        assert ev(scalars.soundex(F.lit(name))) == code == scalars._soundex_of(name), name
    h = 2166136261
    for ch in "héllo":
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    assert ev(scalars.fnv1a(F.lit("héllo"))) == h
    assert ev(scalars.tokens_ascii(F.lit("The B-52, a Big_Plane!"))) == ["the", "52", "big_plane"]
    assert ev(scalars.tokens_unicode(F.lit("The Éa — b 1!"))) == ["éa", "b", "1"]
    assert ev(scalars.estimate_tokens(F.lit("abcd efgh"))) == 3 and ev(scalars.estimate_tokens(F.lit("机器学习"))) == 4 and ev(scalars.estimate_tokens(F.lit(""))) == 0
    assert ev(scalars.chunks(F.lit("x" * 1000), 512, 64)) == ["x" * 512, "x" * 512, "x" * 104] and ev(scalars.chunks(F.lit(""))) == []
    assert ev(scalars.cosine(F.lit([1.0, 0.0]), F.lit([1.0]))) == 0.0 and ev(scalars.cosine(F.lit([0.0]), F.lit([1.0]))) == 0.0
    assert ev(scalars.digits_to_ascii(F.lit("٢٥ ۳ ४"))) == "25 3 4"
    assert ev(scalars.hmac_sha256(b"k" * 80, F.lit("message"))) == hmac.new(b"k" * 80, b"message", hashlib.sha256).hexdigest()
    assert [scalars.interval_ms(x) for x in ("5m", "250ms", "1h", 7, "2d", "3s")] == [300000, 250, 3600000, 7, 172800000, 3000]
    with pytest.raises(ValueError):
        scalars.interval_ms("5 parsecs")


# Pipelines.
@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("1", 28, 1500, "active"), ("2", 34, 3200, "active"), ("3", 45, 800, "suspended"), ("4", 22, 2100, "active")], "_id string, age int, balance int, status string")


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([("p1", "Turing Machines", "1", 1500), ("p2", "Computability", "1", 3200), ("p3", "Resistance", "2", 800), ("p4", "Orphan", None, 1)], "_id string, title string, authorId string, views int")


def test_group(users):
    out = aggregate(users, [{"$match": {"status": "active"}}, {"$group": {"_id": "$status", "n": {"$count": 1}, "total": {"$sum": "$balance"}, "ones": {"$sum": 1}, "low": {"$min": "$age"}}}]).first()
    assert (out["n"], out["total"], out["ones"], out["low"]) == (3, 6800, 3, 22)
    assert aggregate(users, []).count() == 4
    assert aggregate(users, [{"$match": {"age": {"$gt": 25}}}, {"$match": {"status": "active"}}]).count() == 2
    assert aggregate(users, [{"$group": {"_id": "$status", "n": {"$count": 1}}}, {"$match": {"n": {"$gt": 1}}}]).count() == 1
    for bad in ({"$nope": {}}, {"$group": {"_id": None, "x": {"$nope": "$age"}}}):
        with pytest.raises(PipelineError):
            aggregate(users, [bad])


def test_lookup(users, posts):
    out = {r["_id"]: r for r in joins.lookup(users, posts, "_id", "authorId", "posts").collect()}
    assert len(out) == 4 and len(out["1"]["posts"]) == 2 and out["3"]["posts"] == []
    single = {r["_id"]: r["post"] for r in joins.lookup(users, posts, "_id", "authorId", "post", single=True).collect()}
    assert single["1"]["title"] == "Turing Machines" and single["4"] is None
    back = {r["_id"]: r["a"] for r in joins.lookup(posts, users, "authorId", "_id", "a").collect()}
    assert back["p4"] == []  # a null key matches nothing
    cast = joins.lookup(users.withColumn("k", F.col("_id").cast("int")), posts, "k", "authorId", "posts")
    assert sum(len(r["posts"]) for r in cast.collect()) == 3


def test_unwind(spark):
    df = spark.createDataFrame([("1", ["a", "b"], 1), ("2", [], 2), ("3", None, 3)], "_id string, t array<string>, s int")
    assert values(joins.unwind(df, "$t").na.fill("-", ["t"]), "_id", "t") == [("1", "a"), ("1", "b"), ("2", "-")]
    assert joins.unwind(df, "s").count() == 3


def test_spill_sizes(spark):
    df = spark.range(350).select(F.col("id").alias("n"))
    assert aggregate(df, [{"$group": {"_id": None, "s": {"$sum": "$n"}, "c": {"$count": 1}}}]).first()[1:] == (61075, 350)
    regional = spark.range(800).select(F.when(F.col("id") % 4 == 0, "EU").otherwise("US").alias("region"))
    assert dict(values(aggregate(regional, [{"$group": {"_id": "$region", "n": {"$count": 1}}}]), "_id", "n"))["EU"] == 200


# Updates.
@pytest.fixture(scope="module")
def account(spark):
    return spark.createDataFrame([("u", 100, 50, ["developer"], ("light", 14)), ("v", None, None, None, None)], "_id string, balance int, score int, tags array<string>, profile struct<theme:string,views:int>")


def test_updates(account):
    out = updates.apply_update(account, {"$set": {"profile.theme": "cyberpunk"}, "$inc": {"profile.views": 1, "balance": 50}, "$mul": {"score": 2}, "$push": {"tags": {"$each": ["crypto", "security"]}}}, F.col("_id") == "u")
    u = {r["_id"]: r for r in out.collect()}["u"]
    assert (u["balance"], u["score"], tuple(u["profile"]), u["tags"]) == (150, 100, ("cyberpunk", 15), ["developer", "crypto", "security"])
    assert {r["_id"]: r for r in out.collect()}["v"]["balance"] is None
    both = {r["_id"]: r for r in updates.apply_update(account, {"$inc": {"balance": 5}, "$mul": {"score": 3}, "$min": {"profile.views": 3}, "$addToSet": {"tags": "developer"}}).collect()}
    assert both["v"]["balance"] == 5 and both["v"]["score"] == 0 and both["v"]["tags"] == ["developer"] and both["u"]["tags"] == ["developer"] and both["u"]["profile"]["views"] == 3
    gone = updates.apply_update(account, {"$unset": {"score": 1, "nothing": 1}, "$pull": {"tags": "developer"}, "$set": {"new.a.b": 1, "profile.more": "x"}}).collect()[0]
    assert gone["score"] is None and gone["tags"] == [] and gone["new"]["a"]["b"] == 1 and gone["profile"]["more"] == "x" and gone["profile"]["theme"] == "light"
    with pytest.raises(updates.UpdateError):
        updates.apply_update(account, {"$nope": {"a": 1}})


def test_upsert_and_bulk(spark, account):
    df = updates.update_one(account, {"_id": "alice"}, {"$inc": {"balance": 500}}, upsert=True)
    df = updates.update_one(df, {"_id": "alice"}, {"$inc": {"balance": 100}}, upsert=True)
    assert dict(values(df.where("_id = 'alice'"), "_id", "balance")) == {"alice": 600}
    orders = spark.createDataFrame([], "_id string, orderId int, total int, status string")
    out, done = updates.bulk_write(orders, [
        {"insertOne": {"document": {"_id": "1", "orderId": 1, "total": 10, "status": "new"}}}, {"insertOne": {"document": {"_id": "2", "orderId": 2, "total": 20, "status": "new"}}},
        {"updateOne": {"filter": {"orderId": 1}, "update": {"$set": {"status": "shipped"}}}}, {"updateOne": {"filter": {"orderId": 3}, "update": {"$set": {"_id": "3", "total": 5}}, "upsert": True}},
    ])
    assert (done["inserted"], done["modified"], done["upserted"], done["errors"]) == (2, 1, 1, []) and out.count() == 3
    _, failed = updates.bulk_write(orders, [{"nope": {}}, {"insertOne": {"document": {"_id": "9"}}}])
    assert failed["inserted"] == 0 and failed["errors"][0]["index"] == 0
    _, on = updates.bulk_write(orders, [{"nope": {}}, {"insertOne": {"document": {"_id": "9"}}}], ordered=False)
    assert on["inserted"] == 1


def test_queue_lifecycle_and_trash(spark):
    jobs = spark.createDataFrame([("a", 1, "pending", 1, 0), ("b", 9, "pending", 2, 2), ("c", 9, "done", 0, 0)], "_id string, priority int, status string, createdAt int, attempts int")
    assert updates.dequeue(jobs).first()["_id"] == "b" and updates.depth(updates.acknowledge(jobs, ["b"])) == 1
    assert {r["_id"]: r["status"] for r in updates.fail(jobs, ["a", "b"]).collect()} == {"a": "pending", "b": "failed", "c": "done"}
    log = spark.createDataFrame([(str(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(13)], "_id string, createdAt timestamp_ntz")
    kept, archived = updates.lifecycle(log, "createdAt", ttl="7d", most=5, now=datetime.datetime(2024, 1, 13))
    assert kept.count() == 5 and archived.count() == 8
    binned = updates.trash(jobs, {"status": "pending"}, datetime.datetime(2024, 1, 1))
    assert updates.restore(updates.delete_many(jobs, {"status": "pending"}), binned, {"_id": "a"}).count() == 2
    assert updates.evict(binned.withColumn("bytes", F.lit(10)), most_bytes=15).count() == 1 and updates.evict(binned, before=datetime.datetime(2025, 1, 1)).count() == 0


def test_schema(spark):
    df = spark.createDataFrame([("1", "Lamp", 9.5, None), ("2", "x", -1.0, True), ("3", None, None, False)], "_id string, title string, price double, inStock boolean")
    rules = {"title": {"required": True, "type": "string", "min": 3}, "price": {"required": True, "min": 0}, "inStock": {"default": True}}
    assert values(schema.validate(df, rules), "_id", "inStock") == [("1", True)]
    assert {r["_id"]: len(r["_violations"]) for r in schema.violations(df, rules).collect()} == {"2": 2, "3": 2}
    assert schema.validate(df, {}) is df and schema.violations(df, {"nowhere": {"required": True}}).count() == 3
    assert schema.violations(df, {"price": {"type": "string"}}).count() == 2 and schema.violations(df, {"title": {"validate": lambda c: c.startswith("L")}}).count() == 1
    twice = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "u string, _id int")
    assert values(schema.unique_violations(twice, ["u"]), "u", "n") == [("a", 2)]
    with pytest.raises(schema.DuplicateKeyError):
        updates.insert(twice.limit(1), twice.limit(1), unique=["u"])


# Time, space, graphs.
def test_time(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([(t(1), 22.5, 1012), (t(2), 23.0, 1014), (t(6), 24.0, None), (None, 1.0, 1)], "timestamp timestamp_ntz, temperature double, pressure int")
    out = timeseries.bucket(df, "timestamp", "5m", {"avgTemp": {"$avg": "temperature"}, "maxPressure": {"$max": "pressure"}, "first": {"$first": "temperature"}}).collect()
    assert [(r["count"], r["avgTemp"], r["maxPressure"], r["first"]) for r in out] == [(2, 22.75, 1014, 22.5), (1, 24.0, 0, 24.0)] and out[0]["_id"] == "2024-01-01T10:00:00.000Z"
    points = spark.createDataFrame([(1000, 10), (2000, 20), (65000, 100)], "timestamp long, value int")
    assert [(r["windowStart"], r["count"], r["avg"]) for r in timeseries.rollup(points).collect()] == [(0, 2, 15.0), (60000, 1, 100.0)]
    texts = df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    assert timeseries.bucket(texts, "timestamp", "5m", {}).count() == 2


def test_geo(spark):
    rows = [("Empire State Building", -73.9857, 40.7484), ("Central Park", -73.9654, 40.7829), ("Statue of Liberty", -74.0445, 40.6892), ("nowhere", None, None)]
    df = spark.createDataFrame(rows, "name string, lon double, lat double")
    places = df.select("name", F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("location"))
    assert [r["name"] for r in geo.near(places, (-73.9851, 40.7589), max_distance=5000).collect()] == ["Empire State Building", "Central Park"]
    assert geo.near(places, (-73.9851, 40.7589), min_distance=5000).count() == 1
    assert values(geo.within_polygon(places, [(-74, 40.7), (-73.9, 40.7), (-73.9, 40.76), (-74, 40.76)]), "name") == [("Empire State Building",)]
    assert [r["name"] for r in geo.nearest(df, (40.69, -74.04), 1).collect()] == ["Statue of Liberty"] and geo.in_box(df, 40.7, -74, 40.75, -73.9).count() == 1


def test_points_on_an_edge_are_outside(spark):
    points = [(85.0, 0.0), (45.0, 0.0), (0.0, 30.0), (37.41, 22.59), (0.0, 0.0), (60.0, 0.0), (1.0, 1.0), (37.41, 22.58), (37.42, 22.59), (None, 1.0)]
    places = spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", F.struct(F.array("lon", "lat").alias("coordinates")).alias("location"))
    for corners in ([(0, 0), (60, 0), (0, 60)], [(0, 60), (60, 0), (0, 0)], [(0, 0), (60, 0), (0, 60), (0, 0)]):
        assert values(geo.within_polygon(places, corners), "lon", "lat") == [(1.0, 1.0), (37.41, 22.58)]


def test_times_go_to_the_nearest_millisecond(spark):
    texts = ["2024-01-01 00:04:59.999499", "2024-01-01 00:04:59.9995", "2024-01-01 00:05:00", "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.999501"]
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(texts)], "t string, v double")
    for times in (df, df.withColumn("t", F.col("t").cast("timestamp_ntz"))):
        assert [r[0] for r in times.select(timeseries.millis(times, "t")).collect()] == [1704067499999, 1704067500000, 1704067500000, -1, 0]
        late = times.where("v < 3")
        assert values(timeseries.bucket(late, "t", "5m", {"mean": {"$avg": "v"}}), "bucketStart", "count", "mean") == [(1704067200000, 1, 0.0), (1704067500000, 2, 1.5)]
        assert values(timeseries.rollup(late, "t", "v", 60_000), "windowStart", "count") == [(1704067440000, 1), (1704067500000, 2)]


def test_round_product(spark):
    df = spark.createDataFrame([(0.1234565,), (-0.1234565,), (49.577539062499994,), (1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scalars.round_product("x", 6)).collect()]
    away = lambda x: math.copysign(math.floor(abs(x * 1e6) + 0.5), x) / 1e6
    assert got == [None if r.x is None else away(r.x) for r in df.collect()]


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B", "x", 1.0), ("B", "C", "x", 2.0), ("A", "C", "y", 5.0), ("D", "D", "x", 1.0)], "src string, dst string, label string, weight double")
    best = graph.shortest_path(edges, "A", "C").first()
    assert best["path"] == ["A", "B", "C"] and best["distance"] == 3.0 and graph.shortest_path(edges, "C", "A").count() == 0
    vertices = graph.with_nodes(spark.createDataFrame([("A", "a")], "id string, name string"), edges)
    assert vertices.count() == 4 and values(graph.neighbours(edges, vertices, "A", "x"), "id") == [("B",)]
    assert graph.nodes_in_cycles(edges).count() == 0
    loop = edges.select("src", "dst").union(spark.createDataFrame([("C", "A")], "src string, dst string"))
    assert values(graph.nodes_in_cycles(loop), "node") == [("A",), ("B",), ("C",)]


# Text and vectors.
def test_graph_matches_brute_force(spark):
    rng = random.Random(8)
    for n, m in ((12, 14), (30, 45), (20, 60)):
        pairs = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9)) for _ in range(m)]
        df = spark.createDataFrame(pairs, "src long, dst long, weight long")
        far = {(a, b): float("inf") for a in range(n) for b in range(n)}
        for a, b, w in pairs:
            if a != b:
                far[a, b] = min(far[a, b], w)
        for k in range(n):
            for a in range(n):
                for b in range(n):
                    far[a, b] = min(far[a, b], far[a, k] + far[k, b])
        assert {r.node for r in graph.nodes_in_cycles(df).collect()} == {a for a in range(n) if far[a, a] < float("inf")}
        source = pairs[0][0]
        assert {r.node: r.distance for r in graph.shortest_paths(df, source).collect()} == {source: 0.0} | {b: far[source, b] for b in range(n) if b != source and far[source, b] < float("inf")}


def test_paths_of_equal_length_and_bounded_tasks(spark):
    df = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("A", "C", 5.0), ("A", "D", 1.0), ("D", "C", 1.0), ("C", "E", 1.0), ("A", "F", None)], "src string, dst string, weight double")
    got = {r["node"]: (r["distance"], r["path"]) for r in graph.shortest_paths(df, "A").collect()}
    assert got == {"A": (0.0, ["A"]), "B": (1.0, ["A", "B"]), "D": (1.0, ["A", "D"]), "C": (2.0, ["A", "B", "C"]), "E": (3.0, ["A", "B", "C", "E"])}
    assert graph.spread(df, "src", rows=20 * graph.TASK_ROWS + 1).rdd.getNumPartitions() == 21 and graph.spread(df, "src").rdd.getNumPartitions() == 4


def test_graphs_do_not_depend_on_broadcasts(spark, monkeypatch):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (8, 1), (6, 9)]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    asked = []
    for most in (100, 0):
        monkeypatch.setattr(graph, "sized", lambda small, limit=0, real=most: asked.append(1) or (F.broadcast(small) if real else small))
        assert values(graph.nodes_in_cycles(df), "node") == [(i,) for i in range(1, 7)]
        assert values(graph.shortest_paths(df, 8), "node", "distance") == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0), (6, 6.0), (8, 0.0), (9, 7.0)]
    assert asked


def naive_embedding(text, dimensions):
    tokens = text.lower().split()
    joined = "".join(tokens)
    for i in range(len(joined) - 1):
        tokens += [joined[i : i + 2], *([joined[i : i + 3]] if i < len(joined) - 2 else [])]
    out = [0.0] * dimensions
    for i, token in enumerate(tokens):
        h = 0x811C9DC5
        for c in token:
            h = (h ^ ord(c)) * 0x01000193 % (1 << 32)
        out[min(h, (1 << 32) - h) % dimensions] += (i + 1) ** -0.5
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out]


@pytest.mark.parametrize("text", ["a", "ab", "a b", "Hello wide World", "机器学习 与 AI", " x \t yy  zzz\n", "naïve 🙂 façade " * 20])
def test_embedding_matches_a_naive_one(text):
    assert vectors.embed_text(text, 64) == pytest.approx(naive_embedding(text, 64), abs=1e-12)


def test_embeddings_of_a_batch_are_those_of_each_text():
    texts = ["a", None, "ab", "", "a b", "Hello wide World", " ", "机器学习 与 AI", "naïve 🙂 façade " * 20, "x" * (vectors._SLICE + 1), "abc"]
    parts = list(vectors._slices(texts))
    assert sum(parts, []) == texts and len(parts) == 3
    got = [row.tolist() for part in parts for row in vectors._embed(part, 64)]
    assert got == [vectors.embed_text(t, 64) for t in texts]
    assert all(x == pytest.approx(naive_embedding(t, 64), abs=1e-12) for t, x in zip(texts, got) if t and t.strip() and len(t) < 1000)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 21])
def test_merkle_subtrees(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame(list(enumerate(leaves)), "pos long, hash string")
    want = integrity.merkle_levels(df)[-1].first()["hash"]
    assert [integrity.merkle_root(df, height=h).first()["root"] for h in (1, 3, 12)] == [want] * 3


def test_a_shared_folder_is_asked_for(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        graph.shared_folder(Session)


def test_search(spark):
    docs = spark.createDataFrame([("doc_1", "Encrypted cryptographic database engine"), ("doc_2", "Relational database"), ("doc_3", "Cooking with garlic"), ("doc_4", None)], "doc_id string, text string")
    assert [r["doc_id"] for r in text.text_index_search(docs, "Cryptographic Database").collect()] == ["doc_1", "doc_2"]
    assert text.search(docs, "the of").count() == 0 and text.search(docs, "absent").count() == 0
    one, two = (text.search(docs, q).collect()[0]["score"] for q in ("garlic", "garlic garlic"))
    assert math.isclose(two, 2 * one)
    lists = spark.createDataFrame([("l1", "doc_A", 2.0), ("l1", "doc_B", 1.0), ("l2", "doc_B", 2.0), ("l2", "doc_C", 1.0)], "list string, doc_id string, score double")
    fused = text.rrf(lists).orderBy(F.desc("rrf_score")).collect()
    assert len(fused) == 3 and fused[0]["doc_id"] == "doc_B" and math.isclose(fused[0]["rrf_score"], 1 / 62 + 1 / 61)


def _hits(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaab"), i, rng.choice([None, float("nan"), -0.0, 0.0, 1.0, 2.0, rng.random()])) for i in range(300)] + [(None, 1, 1.0), (None, 2, 3.0), ("c", 5, 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "list string, doc_id long, score double")


def test_ranks_by_ranges_are_those_of_one_sort(spark):
    hits = _hits(spark)
    order = [F.desc("score"), F.asc("doc_id")]
    want = values(hits.withColumn("r", F.row_number().over(Window.partitionBy("list").orderBy(*order))).where("list IS NOT NULL"), "list", "doc_id", "r")
    for most in (7, 100, 1000):
        got = text.ranked(hits, ["list"], order, "r", task_rows=most)
        assert values(got.where("list IS NOT NULL"), "list", "doc_id", "r") == want and values(got.where("list IS NULL"), "doc_id", "r") == [(1, 2), (2, 1)]
        assert ("row_number" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 1000)
    assert text.ranked(hits.limit(0), ["list"], order, "r").count() == 0


def test_weighted_fusion_does_not_depend_on_ranges(spark):
    hits = _hits(spark).where("list IS NOT NULL")
    one, many = (values(text.rrf(hits, weights={"b": 2.0}, digits=9, task_rows=n), "doc_id", "rrf_score") for n in (1000, 9))
    assert one == many and len(one) == hits.select("doc_id").distinct().count()


def test_budget_and_duplicates(spark):
    words = " ".join(["word"] * 200)
    docs = spark.createDataFrame([(0, i, f"{words} {i}") for i in range(3)] + [(1, 0, "a b c d"), (1, 1, "a b c d"), (1, 2, "x y z"), (1, 3, " "), (1, 4, None)], "q int, rank int, text string")
    kept = values(text.drop_near_duplicates(docs, by=["q"], rank="rank"), "q", "rank")
    assert kept == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2)]
    packed = text.pack_budget(docs.where("q = 0"), by=["q"], rank="rank", budget=120).collect()
    assert sum(r["tokens"] for r in packed) <= 130 and packed[-1]["trimmed"]


def test_vectors(spark):
    rows = [("a", "crypto", [0.9, 0.1, 0.0, 0.1]), ("b", "crypto", [0.88, 0.12, 0.05, 0.08]), ("c", "food", [0.0, 0.1, 0.9, 0.4])]
    df = spark.createDataFrame(rows, "vec_id string, topic string, embedding array<float>")
    top = vectors.knn(df, [0.9, 0.1, 0.0, 0.1], 2).collect()
    assert [r["vec_id"] for r in top] == ["a", "b"] and top[1]["score"] > 0.98
    assert values(vectors.knn(df, [0.9, 0.1, 0.0, 0.1], 2, spec={"topic": "food"}), "vec_id") == [("c",)]
    v = [0.1, -0.4, 0.7, 0.2, -0.9, 0.3, 0.0, 0.5]
    one = spark.createDataFrame([(v,)], "v array<float>").select("v", vectors.sq8("v").alias("q"), vectors.one_bit("v").alias("bits"))
    r = one.select(vectors.sq8_restore(F.col("q")).alias("r"), vectors.sq8_cosine(F.col("q"), F.lit(v)).alias("c"), "bits", vectors.one_bit_similarity(F.col("bits"), F.col("bits"), 8).alias("s")).first()
    assert max(abs(x - y) for x, y in zip(r["r"], v)) < 0.02 and abs(r["c"] - 1) < 0.015 and r["bits"] == [0b10101101] and r["s"] == 1.0
    e = vectors.embed_text("机器学习与人工智能", 32)
    assert math.isclose(sum(x * x for x in e), 1.0) and vectors.embed_text("", 4) == [0.0] * 4
    assert list(spark.createDataFrame([("Hello world",)], "t string").select(vectors.embed("t", 16).alias("v")).first()["v"]) == vectors.embed_text("Hello world", 16)
    joined = vectors.knn_join(df.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), df, 2, query_key="q", query_vector="qv")
    assert values(joined.where("q = 'a'"), "vec_id") == [("a",), ("b",)] and joined.count() == 6


# History, privacy, integrity.
def test_history(spark):
    versions = spark.createDataFrame([("o", "PENDING", 100, False), ("o", "SHIPPED", 200, False), ("o", "GONE", 300, True)], "doc_id string, status string, commit_ts long, gone boolean")
    at = lambda ts: [r["status"] for r in history.as_of(versions, ts, deleted="gone").collect()]
    assert at(150) == ["PENDING"] and at(250) == ["SHIPPED"] and at(300) == [] and at(50) == []
    assert values(history.vacuum(versions, 250), "commit_ts") == [(200,), (300,)]
    entries = spark.createDataFrame([("d", "old", 1, "A", False), ("d", "new", 1, "B", False), ("e", "x", 5, "A", True)], "docId string, doc string, timestamp long, nodeId string, isTombstone boolean")
    assert values(history.lww_merge(entries.where("nodeId = 'A'"), entries.where("nodeId = 'B'")), "docId", "doc") == [("d", "new")]
    topics = spark.createDataFrame([(t,) for t in ("a.b", "a.c.d", "a:x", "z")], "t string")
    hit = lambda p: [r["t"] for r in topics.where(history.topic_matches(F.col("t"), p)).collect()]
    assert hit("a.*") == ["a.b"] and hit("a:*") == ["a:x"] and hit("*") == ["a.b", "a.c.d", "a:x", "z"] and hit("z") == ["z"] and hit("a.*.d") == ["a.c.d"]


def test_privacy(spark):
    key = b"secret"
    df = spark.createDataFrame([("1", "alice@example.com", "4111 1111 1111 1234", 12.34), ("2", "ab@x.org", "", -5.0), ("3", "nobody", None, None)], "_id string, email string, card string, amount double")
    masked = {r["_id"]: (r["email"], r["card"]) for r in privacy.mask(df, {"email": "email", "card": "card"}).collect()}
    assert masked == {"1": ("a***e@example.com", STARS + "1234"), "2": ("a*@x.org", STARS + "*" * 4), "3": ("***@***.***", STARS + "*" * 4)}
    assert privacy.homomorphic_sum(df, "amount", "_id", "amount", key).first()["sum"] == pytest.approx(7.34)
    hidden = df.select("_id", "email", privacy.encrypt("email", "_id", "email", F.lit(key.ljust(16))).alias("c"))
    opened = hidden.select(privacy.decrypt("c", "_id", "email", F.lit(key.ljust(16))).alias("p"), privacy.decrypt("c", F.lit("9"), "email", F.lit(key.ljust(16))).alias("w"), "email").collect()
    assert all(r["p"] == r["email"] and r["w"] is None for r in opened)
    text_df = spark.createDataFrame([("mail bob@example.com with sk-abcdefghijklmnopqrstuv",), ("clean",), (None,)], "t string").select(privacy.redact("t").alias("r")).collect()
    assert text_df[0]["r"]["violations"] == ["email", "api_key"] and "[REDACTED_EMAIL]" in text_df[0]["r"]["redacted"] and text_df[1]["r"]["safe"] and text_df[2]["r"]["originalLength"] == 0
    tokens = spark.createDataFrame([("Hello",), ("ab",)], "t string").select(F.size(privacy.ngram_tokens("t", "t", key)).alias("n"), privacy.ngram_tokens("t", "t", key, padding=False).alias("k")).collect()
    assert [r["n"] for r in tokens] == [4, 4] and len(tokens[0]["k"]) == 3 and tokens[1]["k"] == [privacy.exact_token_of("t", "ab", key)]
    order = spark.createDataFrame([(x,) for x in (-2.5, -1.0, -0.0, 0.0, 3.0, 1e9)], "x double").select("x", privacy.order_token("x").alias("k")).collect()
    assert [r["x"] for r in sorted(order, key=lambda r: r["k"])] == [-2.5, -1.0, 0.0, 0.0, 3.0, 1e9]
    record = privacy.encrypt_record(df.select("_id", "email", "amount"), {"email": "searchable", "amount": "counter"}, key.ljust(16)).first()
    assert set(record["_enc"]) == {"email"} and set(record["_homo"]) == {"amount"} and set(record["_blind"]) == {"email"}


def test_merkle_and_chain(spark):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5)]
    df = spark.createDataFrame(list(enumerate(leaves)), "pos long, hash string")
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i] + level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    assert integrity.merkle_root(df).first()["root"] == level[0]
    for at in (0, 3, 4):
        assert integrity.merkle_verify(leaves[at], integrity.merkle_proof(df, at), level[0])
    assert not integrity.merkle_verify(leaves[0], integrity.merkle_proof(df, 1), level[0])
    assert integrity.merkle_root(df.limit(0)).first()["root"] == integrity.EMPTY_ROOT
    rows = spark.createDataFrame([("c", i, f"p{i}") for i in range(4)], "by string, t int, p string")
    chained = integrity.chain(rows, by=["by"], order=["t"], payload=F.col("p"))
    assert integrity.chain_breaks(chained, by=["by"]).count() == 0
    broken = chained.withColumn("payload", F.when(F.col("seq") == 2, "forged").otherwise(F.col("payload")))
    assert values(integrity.chain_breaks(broken, by=["by"]), "seq") == [(2,)]
