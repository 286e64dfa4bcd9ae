"""Scalars, time series, geography, graphs, text, vectors and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import geo, graph, text, timeseries, vectors
from .registry import query

# Scalar functions.


@query("fn_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS d FROM part")
def _(t):
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"))


@query("fn_fnv1a", """
SELECT n_nationkey, list_reduce(list_prepend(2166136261::HUGEINT, [unicode(c)::HUGEINT FOR c IN string_split(n_name, '')]), lambda h, x: (xor(h::UBIGINT, x::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS h FROM nation""")
def _(t):
    return t("nation").select("n_nationkey", scalars.fnv1a("n_name").alias("h"))


@query("fn_digits", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS d FROM customer")
def _(t):
    arabic = F.translate(F.col("c_custkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return t("customer").select("c_custkey", scalars.digits_to_ascii(arabic).alias("d"))


ASCII = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1)"
STOP = ", ".join(f"'{w}'" for w in scalars.STOP_WORDS)
UNICODE = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 0 AND x NOT IN ({STOP}))"


@query("tokens_ascii", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {ASCII} AS k FROM documents)")
def _(t):
    k = scalars.tokens_ascii("text")
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("digest"))


@query("tokens_unicode", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {UNICODE} AS k FROM documents)")
def _(t):
    k = scalars.tokens_unicode("text")
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("digest"))


@query("rag_chunk", """
SELECT doc_id, count(*) AS pieces, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, trim(substr(text, (i * 448 + 1)::BIGINT, 512)) AS p FROM documents, unnest(range(0, (length(text) - 1) // 448 + 1)) AS u(i)) WHERE p <> '' GROUP BY 1""")
def _(t):
    return text.chunk(t("documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("text")).alias("chars"))


@query("token_estimate", """
SELECT item_id, greatest(1, ceil(list_sum([CASE WHEN o <= 32 OR o BETWEEN 33 AND 47 OR o BETWEEN 58 AND 64 THEN 35 WHEN o <= 591 THEN 25 WHEN o < 8192 AND NOT o BETWEEN 3584 AND 3711 THEN 52 WHEN o BETWEEN 3584 AND 3711 OR o BETWEEN 12352 AND 12543 OR o BETWEEN 13312 AND 19903 OR o BETWEEN 19968 AND 40959 OR o BETWEEN 44032 AND 55215 THEN 80 ELSE 75 END FOR o IN [unicode(c) FOR c IN string_split(text, '')]]) / 100))::INTEGER AS tokens FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", scalars.estimate_tokens("text").alias("tokens"))


WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({c}), '\\s+')), lambda x: x <> '')"


@query("word_jaccard", f"""
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN a.text = b.text THEN 1 ELSE len(list_intersect({WORDS.format(c='a.text')}, {WORDS.format(c='b.text')})) / len(list_distinct(list_concat({WORDS.format(c='a.text')}, {WORDS.format(c='b.text')}))) END, 6)::DOUBLE AS j
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def _(t):
    a, b = t("benchmark").alias("a"), t("benchmark").alias("b")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(scalars.word_jaccard("a.text", "b.text"), 6).alias("j"))


@query("fn_string_rank", """
SELECT n_nationkey, list_sum([CASE WHEN i <= length(n_name) THEN unicode(n_name[i]) % 256 ELSE 0 END * (256::HUGEINT ** (6 - i))::BIGINT FOR i IN range(1, 7)])::BIGINT AS r FROM nation""")
def _(t):
    return t("nation").select("n_nationkey", scalars.string_rank("n_name").alias("r"))


@query("fn_recency", "SELECT event_id, round(exp(-value / 168), 9) AS weight FROM events")
def _(t):
    return t("events").select("event_id", F.round(scalars.recency(F.col("value")), 9).alias("weight"))


# Time series.
@query("ts_bucket_5m", """
SELECT strftime(to_timestamp(b / 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS _id, b AS bucketStart, count(*) AS count, round(avg(value), 6) AS mean, max(value) AS high
FROM (SELECT *, epoch_ms(ts) // 300000 * 300000 AS b FROM events) GROUP BY b""")
def _(t):
    out = timeseries.bucket(t("events"), "ts", "5m", {"mean": {"$avg": "value"}, "high": {"$max": "value"}})
    return out.withColumn("mean", scalars.round_product("mean", 6))


@query("ts_bucket_first_last", "SELECT epoch_ms(ts) // 3600000 * 3600000 AS bucketStart, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    out = timeseries.bucket(t("events"), "ts", "1h", {"first": {"$first": "event_type"}, "last": {"$last": "event_type"}, "total": {"$sum": "value"}}, tie="event_id")
    return out.select("bucketStart", "first", "last", F.round("total", 4).alias("total"))


@query("ts_rollup", "SELECT epoch_ms(ts) // 60000 * 60000 AS windowStart, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def _(t):
    out = timeseries.rollup(t("events"), "ts", "value")
    return out.withColumns({"sum": scalars.round_product("sum", 4), "avg": scalars.round_product("avg", 6)})


@query("ts_sliding", """
SELECT w AS windowStart, w + INTERVAL 1 HOUR AS windowEnd, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS w FROM events, range(0, 2) AS r(i)) GROUP BY w""")
def _(t):
    return timeseries.sliding(t("events"), "ts", "1 hour", "30 minutes", [F.count(F.lit(1)).alias("n")])


@query("ts_session", """
SELECT user_id, min(ts) AS sessionStart, max(ts) + INTERVAL 1 HOUR AS sessionEnd, count(*) AS n
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s""")
def _(t):
    return timeseries.sessions(t("events"), "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")])


@query("ts_rolling", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), 6) AS value_rolling FROM events")
def _(t):
    return timeseries.rolling(t("events"), "ts", "value", 3_600_000, ["user_id"]).select("event_id", F.round("value_rolling", 6).alias("value_rolling"))


# Geography: positions follow from the keys.
def _points(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", ((k * 37) % 36000 / 100.0 - 180).alias("lon"), ((k * 53) % 17000 / 100.0 - 85).alias("lat"))


POINTS = "(SELECT c_custkey, (c_custkey * 37) % 36000 / 100.0 - 180 AS lon, (c_custkey * 53) % 17000 / 100.0 - 85 AS lat FROM customer)"
METRES = "2 * {r} * atan2(sqrt(h), sqrt(1 - h))"
HAV = "pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2)"


def _located(t):
    return _points(t).select("c_custkey", F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("location"))


@query("geo_near", f"SELECT c_custkey, CAST(round({METRES.format(r='6371000.0')}) AS BIGINT) AS calculatedDistance FROM (SELECT *, {HAV.format(lat='40.0', lon='-74.0')} AS h FROM {POINTS}) WHERE {METRES.format(r='6371000.0')} BETWEEN 200000 AND 3000000")
def _(t):
    return geo.near(_located(t), (-74.0, 40.0), max_distance=3_000_000, min_distance=200_000, tie="c_custkey").select("c_custkey", "calculatedDistance")


@query("geo_bbox", f"SELECT c_custkey FROM {POINTS} WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -20 AND 50")
def _(t):
    return geo.in_box(_points(t), 10, -20, 40, 50).select("c_custkey")


@query("geo_polygon", f"SELECT c_custkey FROM {POINTS} WHERE lat > 0 AND lon > 0 AND lat + lon < 60")
def _(t):
    return geo.within_polygon(_located(t), [(0, 0), (60, 0), (0, 60)]).select("c_custkey")


@query("geo_knn", f"SELECT c_custkey, round({METRES.format(r='6371.0')}, 6) AS distanceKm FROM (SELECT *, {HAV.format(lat='30.0', lon='31.0')} AS h FROM {POINTS}) ORDER BY {METRES.format(r='6371.0')}, c_custkey LIMIT 15")
def _(t):
    return geo.nearest(_points(t), (30.0, 31.0), 15, tie="c_custkey").select("c_custkey", F.round("distanceKm", 6).alias("distanceKm"))


# Graphs.
def _edges(t):
    """From the supplier of each shipment of a part to that of the part's next one, with the number of such steps."""
    after = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    n = t("lineitem").count()
    steps = graph.spread(t("lineitem"), "l_partkey", rows=n).select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(after).alias("dst"))
    return graph.spread(steps.where("src <> dst"), "src", "dst", rows=n).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("graph_neighbours", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 3")
def _(t):
    edges = t("nation").select((F.col("n_regionkey") + 1000).alias("src"), F.col("n_nationkey").alias("dst"), F.lit("has").alias("label"))
    return graph.neighbours(edges, t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 1003, "has")


@query("graph_shortest_path")
def _(t):
    edges = graph.written(_edges(t), "edges")
    return graph.shortest_paths(edges, edges.agg(F.min("src")).first()[0]).select("node", "distance")


@query("graph_cycle")
def _(t):
    edges = _edges(t).select("src", "dst")
    more = t.spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-9, -9), (-10, -11), (-11, -1)], "src long, dst long")
    return graph.nodes_in_cycles(edges.unionByName(more))


@query("graph_unique_edges", "SELECT l_suppkey AS src, l_partkey AS dst, arg_max(l_quantity, (l_orderkey * 100 + l_linenumber) * 1000 + l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def _(t):
    edges = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000 + F.col("l_quantity")).alias("seq"))
    return graph.unique_edges(edges, "seq").select("src", "dst", "weight")


# Text.
def _bm25_sql(tokens: str, k1: float, terms: list[str], limit: int, digits: int) -> str:
    columns = ", ".join(f"len(list_filter(k, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    parts = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * {k1 + 1} / (f{i} + {k1} * (1 - 0.75 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"""WITH w AS (SELECT doc_id, len(k)::DOUBLE AS n, {columns} FROM (SELECT doc_id, {tokens} AS k FROM documents)), s AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, {stats} FROM w)
SELECT doc_id, round({parts}, {digits}) AS score FROM w, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(terms)))} ORDER BY round({parts}, {digits}) DESC, doc_id LIMIT {limit}"""


@query("bm25_ascii", _bm25_sql(ASCII, 1.2, ["therely", "onwhst"], 20, 4))
def _(t):
    return text.text_index_search(t("documents"), "therely onwhst")


@query("bm25_unicode", _bm25_sql(UNICODE, 1.5, ["éeau", "tionré"], 10, 6))
def _(t):
    return text.search(t("documents"), "Éeau the tionré!", digits=6)


def _lists(t):
    a = t("orders").select(F.lit("price").alias("list"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return a.unionByName(t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").alias("score")).select(F.lit("quantity").alias("list"), "doc_id", "score"))


LISTS = "(SELECT 'price' AS list, o_orderkey AS doc_id, o_totalprice AS score FROM orders UNION ALL SELECT 'quantity', l_orderkey, sum(l_quantity) FROM lineitem GROUP BY 2)"


@query("rrf", f"SELECT doc_id, round(sum(1 / (60 + r)), 5) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, doc_id) AS r FROM {LISTS}) GROUP BY 1")
def _(t):
    return text.rrf(_lists(t), digits=5)


@query("rrf_weighted", f"SELECT doc_id, round(sum(CASE WHEN list = 'price' THEN 2.0 ELSE 1.0 END / (60 + r)), 9) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, doc_id) AS r FROM {LISTS}) GROUP BY 1")
def _(t):
    return text.rrf(_lists(t), weights={"price": 2.0}, digits=9)


@query("ngram_scan", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ")
def _(t):
    return text.contains_all_ngrams(t("part"), "p_name", "ring").select("p_partkey", "p_name")


@query("near_dup_pages")
def _(t):
    rows = t("conversations").select("conv_id", "turn", "text")
    return text.drop_near_duplicates(rows, by=["conv_id"], rank="turn")


@query("token_budget")
def _(t):
    return text.pack_budget(t("conversations"), by=["conv_id"], rank="turn", budget=300)


# Vectors.
def _query_vector(t):
    return t("embeddings").where("vec_id = 0").first()["embedding"]


Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
DOUBLES = "list_transform({c}, lambda x: x::DOUBLE)"
COSINE = f"list_cosine_similarity({DOUBLES.format(c='embedding')}, {DOUBLES.format(c='q')})"


@query("knn_cosine", f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings, {Q} ORDER BY {COSINE} DESC, vec_id LIMIT 20")
def _(t):
    return vectors.knn(t("embeddings"), _query_vector(t), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings, {Q} WHERE label = 1 ORDER BY {COSINE} DESC, vec_id LIMIT 20")
def _(t):
    return vectors.knn(t("embeddings"), _query_vector(t), 20, spec={"label": 1}).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_euclidean", f"SELECT vec_id, round(0 - list_distance({DOUBLES.format(c='embedding')}, {DOUBLES.format(c='q')}), 6) AS score FROM embeddings, {Q} ORDER BY list_distance({DOUBLES.format(c='embedding')}, {DOUBLES.format(c='q')}), vec_id LIMIT 20")
def _(t):
    return vectors.knn(t("embeddings"), _query_vector(t), 20, metric="euclidean").select("vec_id", F.round("score", 6).alias("score"))


@query("knn_dot", f"SELECT vec_id, round(list_dot_product({DOUBLES.format(c='embedding')}, {DOUBLES.format(c='q')}), 6) AS score FROM embeddings, {Q} ORDER BY list_dot_product({DOUBLES.format(c='embedding')}, {DOUBLES.format(c='q')}) DESC, vec_id LIMIT 20")
def _(t):
    return vectors.knn(t("embeddings"), _query_vector(t), 20, metric="dot").select("vec_id", F.round("score", 6).alias("score"))


@query("knn_join", f"""
SELECT query_id, vec_id, round(s, 5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity({DOUBLES.format(c='a.embedding')}, {DOUBLES.format(c='b.embedding')}) AS s,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity({DOUBLES.format(c='a.embedding')}, {DOUBLES.format(c='b.embedding')}) DESC, b.vec_id) AS r FROM embeddings a, embeddings b) WHERE r <= 3""")
def _(t):
    queries = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.knn_join(queries, t("embeddings"), 3, query_key="query_id", query_vector="query").withColumn("score", F.round("score", 5))


CODES = "(SELECT vec_id, embedding, lo, st, list_transform(embedding, lambda x: CASE WHEN st = 0 THEN 0 ELSE floor((x::DOUBLE - lo) / st + 0.5)::INT END) AS codes FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 255 AS st FROM embeddings))"


@query("sq8_quantise", f"SELECT vec_id, list_sum(codes)::BIGINT AS total, round(lo, 6) AS low, round(st, 9) AS step FROM {CODES}")
def _(t):
    q = t("embeddings").select("vec_id", vectors.sq8("embedding").alias("q"))
    return q.select("vec_id", F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.round("q.low", 6).alias("low"), F.round("q.step", 9).alias("step"))


@query("sq8_cosine", f"SELECT vec_id, round(list_cosine_similarity(list_transform(codes, lambda c: c * st + lo), {DOUBLES.format(c='q')}), 5) AS score FROM {CODES}, {Q}")
def _(t):
    query_vector = F.array(*(F.lit(float(x)) for x in _query_vector(t)))
    return t("embeddings").select("vec_id", F.round(vectors.sq8_cosine(vectors.sq8("embedding"), query_vector), 5).alias("score"))


@query("hamming_one_bit", f"SELECT vec_id, list_sum([CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)])::BIGINT AS d FROM embeddings, {Q}")
def _(t):
    words = t.spark.range(1).select(vectors.one_bit(F.lit([float(x) for x in _query_vector(t)])).alias("w")).first()["w"]
    return t("embeddings").select("vec_id", scalars.hamming(vectors.one_bit("embedding"), F.lit(words)).cast("long").alias("d"))


@query("vector_memory", "SELECT count(*) * 64 * 4 AS float32, count(*) * (64 + 16) AS sq8, count(*) * (2 * 4 + 8) AS one_bit FROM embeddings")
def _(t):
    return t("embeddings").agg(F.count(F.lit(1)).alias("n")).select(vectors.memory_estimate(F.col("n"), 64).alias("m")).select("m.*")


@query("hash_embedding")
def _(t):
    return t("documents").select("doc_id", vectors.embed("text").alias("vector"))


@query("rag_ask")
def _(t):
    return vectors.rag_ask(vectors.rag_ingest(t("documents")), "what is this")


def _embedded(t):
    return t("documents").select("doc_id", "text", vectors.embed("text").alias("vector"))


@query("hybrid_search")
def _(t):
    return vectors.hybrid(_embedded(t), "the heon", vectors.embed_text("the heon"))


@query("agent_recall")
def _(t):
    memories = _embedded(t).select(F.col("doc_id").alias("_id"), "text", "vector", (F.col("doc_id") * 3_600_000).alias("createdAt"), F.lit(None).cast("long").alias("expiresAt"), F.lit(1.0).alias("importance"), F.lit("a").alias("agent"))
    return vectors.shared_recall(memories, vectors.embed_text("the heon"), 1_000_000_000, agents=["a"])


@query("semantic_cache")
def _(t):
    """Every document is a cached prompt; every fiftieth is asked, half of them with another word."""
    cache = _embedded(t).select(F.col("doc_id").alias("entry_id"), F.col("text").alias("prompt"), "vector", F.col("text").alias("response"), F.lit(0).cast("long").alias("createdAt"))
    asked = t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("prompt_id"), F.when(F.col("doc_id") % 100 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" x"))).alias("prompt"))
    return vectors.cache_lookup(asked.withColumn("vector", vectors.embed("prompt")), cache, 1000).select("prompt_id", "tier")
