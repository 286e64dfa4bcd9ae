"""Mutations, schema rules, history, change, privacy, integrity, sources and streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph, history, integrity, privacy, schema, updates
from ..operators.filters import find
from ..sources import readers, writers
from ..streaming import streams
from .registry import query

KEY = b"docspark-demo-key"
NOW = datetime.datetime(2024, 1, 31)
STATES = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _orders(t):
    return t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


# Updates.
def _update(name: str, update: dict, price: str, status: str = "o_orderstatus", spec=None, where: str = "o_totalprice > 200000"):
    @query(name, f"SELECT o_orderkey, CASE WHEN {where} THEN {status} ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {where} THEN {price} ELSE o_totalprice END AS o_totalprice FROM orders")
    def _(t):
        return updates.update_many(_orders(t), spec or {"o_totalprice": {"$gt": 200000}}, update, key="o_orderkey")


_update("update_set", {"$set": {"o_orderstatus": "X"}}, "o_totalprice", "'X'")
_update("update_unset", {"$unset": {"o_orderstatus": 1}}, "o_totalprice", "NULL")
_update("update_inc", {"$inc": {"o_totalprice": 10.5}}, "o_totalprice + 10.5::DOUBLE")
_update("update_mul", {"$mul": {"o_totalprice": 2}}, "o_totalprice * 2")
_update("update_min", {"$min": {"o_totalprice": 250000}}, "least(o_totalprice, 250000)")
_update("update_max", {"$max": {"o_totalprice": 250000}}, "greatest(o_totalprice, 250000)")
_update("update_replace", {"o_orderstatus": "R"}, "NULL", "'R'")

@query("update_one", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(x.o_orderkey) FROM orders AS x WHERE x.o_orderstatus = 'F') THEN '1' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def _(t):
    return updates.update_one(_orders(t), {"o_orderstatus": "F"}, {"$set": {"o_orderstatus": "1"}}, key="o_orderkey")


@query("update_nested", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'RISK' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 5 END AS level FROM customer")
def _(t):
    nested = t("customer").select("c_custkey", "c_acctbal", F.struct("c_name", F.struct("c_mktsegment").alias("more")).alias("c"))
    out = updates.update_many(nested, {"c_acctbal": {"$lt": 0}}, {"$set": {"c.more.c_mktsegment": "RISK", "c.more.level": 5}}, key="c_custkey")
    return out.select("c_custkey", "c.c_name", F.col("c.more.c_mktsegment").alias("segment"), F.col("c.more.level").alias("level"))


def _lines(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))


LINES = "(SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS a FROM lineitem GROUP BY 1)"


def _array_update(name: str, update: dict, sql: str):
    @query(name, f"SELECT k, len(a)::BIGINT AS n, array_to_string(a, ',') AS a FROM (SELECT k, {sql} AS a FROM {LINES})")
    def _(t):
        out = updates.apply_update(_lines(t), update, key="k")
        return out.select("k", F.size("a").cast("long").alias("n"), F.array_join("a", ",").alias("a"))


_array_update("update_push", {"$push": {"a": 9}}, "list_append(a, 9)")
_array_update("update_push_each", {"$push": {"a": {"$each": [8, 9], "$position": 1, "$slice": 4}}}, "list_concat(a[1:1], [8, 9], a[2:])[1:4]")
_array_update("update_pull", {"$pull": {"a": 2}}, "list_filter(a, lambda x: x <> 2)")
_array_update("update_add_to_set", {"$addToSet": {"a": {"$each": [1, 9, 9]}}}, "list_concat(a, list_filter([1, 9], lambda x: NOT list_contains(a, x)))")
_array_update("update_pop", {"$pop": {"a": 1}}, "a[1:len(a) - 1]")
_array_update("update_shift", {"$pop": {"a": -1}}, "a[2:]")


@query("upsert", "SELECT * FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE 10000000 END, c_name, c_nationkey, 0::DOUBLE, c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT * FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 20 <> 0")
def _(t):
    key = F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 0).otherwise(10_000_000)
    rows = t("customer").where("c_custkey % 10 = 0").withColumn("c_custkey", key).withColumn("c_acctbal", F.lit(0.0))
    return updates.upsert(t("customer"), rows, "c_custkey")


@query("upsert_one", f"{STATES} UNION ALL SELECT -1, 'N', 7::DOUBLE")
def _(t):
    return updates.update_one(_orders(t), {"o_orderkey": -1}, {"$set": {"o_orderstatus": "N"}, "$inc": {"o_totalprice": 7}}, key="o_orderkey", upsert=True)


@query("find_one_and_update", "SELECT o_orderkey, 'Z' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 100000)")
def _(t):
    return updates.find_one_and_update(_orders(t), {"o_totalprice": {"$gt": 100000}}, {"$set": {"o_orderstatus": "Z"}}, key="o_orderkey")[0]


@query("delete_many", f"{STATES} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def _(t):
    return updates.delete_many(_orders(t), {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}})


@query("delete_one", f"{STATES} WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def _(t):
    return updates.delete_one(_orders(t), {"$or": [{"o_orderstatus": "O"}]}, key="o_orderkey")


@query("trash_restore", f"{STATES} WHERE o_orderstatus <> 'F' OR o_totalprice >= 100000")
def _(t):
    df = _orders(t)
    binned = updates.trash(df, {"o_orderstatus": "F"}, NOW)
    return updates.restore(updates.delete_many(df, {"o_orderstatus": "F"}), binned, {"o_totalprice": {"$gte": 100000}})


@query("trash_list", f"{STATES} WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def _(t):
    return updates.list_trash(updates.trash(_orders(t), {"o_orderstatus": "F"}, NOW), key="o_orderkey").drop("_deletedAt")


@query("bulk_write", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -5, 'I', 1::DOUBLE")
def _(t):
    out, _ = updates.bulk_write(_orders(t), [
        {"insertOne": {"document": {"o_orderkey": -5, "o_orderstatus": "I", "o_totalprice": 1.0}}}, {"deleteMany": {"filter": {"o_orderstatus": "P"}}},
        {"updateMany": {"filter": {"o_totalprice": {"$gt": 300000}}, "update": {"$set": {"o_orderstatus": "B"}}}},
    ], key="o_orderkey")
    return out


@query("ttl_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(t):
    return updates.ttl_purge(t("events"), "ts", "7d", NOW).select("event_id")


@query("capped", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(t):
    return updates.keep_newest(t("events"), "ts", 500, "event_id").select("event_id", "ts")


@query("lifecycle_archive", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def _(t):
    return updates.lifecycle(t("events"), "ts", ttl="10d", most=1000, now=NOW, key="event_id")[1].select("event_id")


@query("counter", "SELECT event_type AS name, sum(user_id)::BIGINT AS value FROM events GROUP BY 1")
def _(t):
    return updates.counter(t("events").select(F.col("event_type").alias("name"), F.col("user_id").alias("delta")))


@query("queue_next", "SELECT event_id AS _id, user_id AS priority FROM events WHERE event_type = 'click' ORDER BY user_id DESC, ts, event_id LIMIT 5")
def _(t):
    jobs = t("events").select(F.col("event_id").alias("_id"), F.col("user_id").alias("priority"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"), F.col("ts").alias("createdAt"))
    return updates.dequeue(jobs, 5).select("_id", "priority")


@query("unique_violations", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return schema.unique_violations(t("customer"), ["c_nationkey", "c_mktsegment"])


RULES = {"p_size": {"required": True, "type": "number", "min": 5}, "p_name": {"type": "string", "match": "^[a-r]"}, "p_brand": {"enum": [f"Brand#{i}" for i in range(20)]}}


@query("schema_violations", f"SELECT p_partkey, (p_size < 5)::BIGINT + (NOT regexp_matches(p_name, '^[a-r]'))::BIGINT + (p_brand NOT IN ({', '.join(repr(f'Brand#{i}') for i in range(20))}))::BIGINT AS n FROM part WHERE n > 0")
def _(t):
    return schema.violations(t("part"), RULES).select("p_partkey", F.size("_violations").cast("long").alias("n"))


@query("schema_defaults", "SELECT p_partkey, coalesce(nullif(p_size % 7, 0), 42) AS n FROM part")
def _(t):
    return schema.validate(t("part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("n")), {"n": {"default": 42, "type": "number"}})


# History and change.
def _versions(t):
    return t("events").select("event_id", "user_id", "ts", "value", (F.col("event_type") == "error").alias("gone"))


@query("as_of", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1 AND event_type <> 'error'""")
def _(t):
    return history.as_of(_versions(t), datetime.datetime(2024, 1, 15), key="user_id", ts="ts", deleted="gone", tie=["event_id"]).select("user_id", "event_id", "value")


@query("lww_merge", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def _(t):
    v = _versions(t)
    return history.lww_merge(v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1"), key="user_id", ts="ts", node="event_id", tombstone="gone").select("user_id", "event_id", "value")


@query("lsm_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return history.latest(t("events").select("user_id", "event_id"), "user_id", ["event_id"])


@query("version_vacuum", """
SELECT event_id FROM (SELECT *, max(CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN ts END) OVER (PARTITION BY user_id) AS v FROM events) WHERE v IS NULL OR ts >= v""")
def _(t):
    return history.vacuum(_versions(t), datetime.datetime(2024, 1, 20), key="user_id", ts="ts").select("event_id")


@query("mvcc_conflicts", """
SELECT a.event_id FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND b.ts > a.ts - INTERVAL 10 MINUTE AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)))""")
def _(t):
    writes = t("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("tx_id"), F.expr("ts - INTERVAL 10 MINUTES").alias("start_ts"), F.col("ts").alias("commit_ts"))
    return history.conflicts(writes).select(F.col("tx_id").alias("event_id"))


@query("oplog_since", "SELECT event_id AS seq, event_type, sha256('seq:' || event_id) AS token FROM events WHERE event_id > 9500")
def _(t):
    log = t("events").select(F.col("event_id").alias("seq"), "event_type")
    return history.read_from(log, 9500).withColumn("token", history.resume_token())


@query("outbox_pending", "SELECT event_id FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 100")
def _(t):
    return history.pending(t("events").select("event_id"), t("events").where("event_type = 'view'"))


@query("event_log_tail", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return history.tail(t("events").select("event_id", "ts"))


@query("event_log_since", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25' ORDER BY ts, event_id LIMIT 200")
def _(t):
    return history.since(t("events").select("event_id", "ts"), datetime.datetime(2024, 1, 25), 200)


@query("topic_delivery", """
SELECT event_id, s FROM events, (VALUES ('a', 'event.click'), ('b', 'event.*'), ('c', '*'), ('d', 'event:*')) AS v(s, p)
WHERE s IN ('b', 'c') OR (s = 'a' AND event_type = 'click')""")
def _(t):
    subscriptions = t.spark.createDataFrame([("a", "event.click"), ("b", "event.*"), ("c", "*"), ("d", "event:*")], "s string, pattern string")
    events = t("events").select("event_id", F.concat(F.lit("event."), F.col("event_type")).alias("topic"))
    return history.deliveries(events, subscriptions).select("event_id", "s")


@query("topic_history", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def _(t):
    return history.topic_history(t("events"), 5, topic="event_type").select("event_type", "event_id")


@query("presence", "SELECT user_id, max(ts) AS last_seen, max(ts) >= TIMESTAMP '2024-01-20' - INTERVAL 3 HOUR AS online FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def _(t):
    return history.presence(t("events"), datetime.datetime(2024, 1, 20), 3 * 3_600_000)


@query("latency_histogram", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, sum((value <= 5)::INT)::BIGINT AS le_5, sum((value <= 25)::INT)::BIGINT AS le_25 FROM events GROUP BY 1")
def _(t):
    at_most = lambda b: F.sum(F.when(F.col("value") <= b, 1).otherwise(0))
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), at_most(5).alias("le_5"), at_most(25).alias("le_25"))


@query("hit_ratio", "SELECT round(sum((event_type = 'view')::INT) / count(*), 9) AS ratio FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    seen = find(t("events"), {"event_type": {"$in": ["view", "click"]}})
    return seen.agg(F.round(F.try_divide(F.sum(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)), F.count(F.lit(1))), 9).alias("ratio"))


# Privacy and integrity.
def _hmac_sql(message: str, key: bytes = KEY) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ p:02x}" for b in block) for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("hmac_token", f"SELECT c_custkey, {_hmac_sql(chr(39) + 'exact:c_name:' + chr(39) + ' || lower(trim(c_name))')} AS token FROM customer")
def _(t):
    return t("customer").select("c_custkey", privacy.exact_token("c_name", "c_name", KEY).alias("token"))


@query("ngram_tokens", f"""
SELECT n_nationkey, n + 4 - n % 4 AS n, first FROM (SELECT n_nationkey, len(list_distinct([substr(lower(n_name), i, 3) FOR i IN range(1, length(n_name) - 1)])) AS n, {_hmac_sql("'ngram:n_name:' || substr(lower(n_name), 1, 3)")} AS first FROM nation)""")
def _(t):
    tokens = privacy.ngram_tokens("n_name", "n_name", KEY)
    return t("nation").select("n_nationkey", F.size(tokens).cast("long").alias("n"), F.get(tokens, F.lit(0)).alias("first"))


@query("range_bucket", f"SELECT p_partkey, {_hmac_sql(chr(39) + 'range:p_size:' + chr(39) + ' || (p_size // 10)')} AS token FROM part")
def _(t):
    return t("part").select("p_partkey", privacy.range_token("p_size", "p_size", KEY).alias("token"))


@query("homomorphic_sum", "SELECT round(sum(round(c_acctbal * 100)) / 100, 2) AS sum FROM customer")
def _(t):
    return privacy.homomorphic_sum(t("customer"), "c_acctbal", "c_custkey", "c_acctbal", KEY).select(F.round("sum", 2).alias("sum"))


@query("mask_email", "SELECT c_custkey, 'C' || repeat('*', 16) || right(c_name, 1) || '@example.org' AS masked, repeat(repeat('*', 4) || '-', 3) || right(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4) AS card, '********' AS secret FROM customer")
def _(t):
    rows = t("customer").select("c_custkey", F.concat("c_name", F.lit("@example.org")).alias("masked"), F.concat(F.lit("4000-0000-000"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("card"), F.lit("x").alias("secret"))
    return privacy.mask(rows, {"masked": "email", "card": "card", "secret": "full"})


def _redacted_sql() -> str:
    running, found = "text", []
    for name, pattern in privacy.PII:
        found.append(f"CASE WHEN regexp_matches({running}, '{pattern}') THEN 1 ELSE 0 END")
        running = f"regexp_replace({running}, '{pattern}', '[REDACTED_{name.upper()}]', 'g')"
    return f"SELECT doc_id, md5({running}) AS digest, ({' + '.join(found)})::BIGINT AS n FROM documents"


@query("pii_redact", _redacted_sql())
def _(t):
    r = t("documents").select("doc_id", privacy.redact("text").alias("r"))
    return r.select("doc_id", F.md5("r.redacted").alias("digest"), F.size("r.violations").cast("long").alias("n"))


@query("rbac", "SELECT s_suppkey, (s_suppkey % 3 = 0 OR s_nationkey = 5) AS allowed FROM supplier")
def _(t):
    requests = t("supplier").select(F.concat(F.lit("u"), F.col("s_suppkey") % 3).alias("user"), F.concat(F.lit("c"), F.col("s_nationkey")).alias("collection"), F.lit("read").alias("action"), "s_suppkey")
    roles = t.spark.createDataFrame([("u0", "admin"), ("u1", "reader"), ("u2", "reader")], "user string, role string")
    permissions = t.spark.createDataFrame([("admin", "*:*"), ("reader", "c5:*"), ("reader", "*:write")], "role string, permission string")
    return privacy.allowed(requests, roles, permissions).select("s_suppkey", "allowed")


@query("subject_erase", "SELECT event_id FROM events WHERE user_id <> 7")
def _(t):
    return privacy.erase_subject(t("events"), "user_id", 7, KEY, "2024-01-31")[0].select("event_id")


@query("field_encryption", "SELECT c_custkey, true AS same, true AS bound FROM customer")
def _(t):
    key = F.lit(privacy.derive_key("secret", "salt"))
    hidden = t("customer").select("c_custkey", "c_name", privacy.encrypt("c_name", "c_custkey", "c_name", key).alias("c"))
    return hidden.select("c_custkey", (privacy.decrypt("c", "c_custkey", "c_name", key) == F.col("c_name")).alias("same"), privacy.decrypt("c", F.col("c_custkey") + 1, "c_name", key).isNull().alias("bound"))


@query("key_rotation", "SELECT c_custkey AS _id, 2::INTEGER AS key_version, true AS same FROM customer")
def _(t):
    old, new = privacy.derive_key("a", "s"), privacy.derive_key("b", "s")
    rows = t("customer").select(F.col("c_custkey").alias("_id"), "c_name", privacy.encrypt("c_name", "c_custkey", "n", F.lit(old)).alias("n"), F.lit(1).alias("key_version"))
    out = privacy.rotate(rows, "n", "n", {1: old}, (2, new))
    return out.select("_id", "key_version", (privacy.decrypt("n", "_id", "n", F.lit(new)) == F.col("c_name")).alias("same"))


@query("private_sum")
def _(t):
    return privacy.private_aggregates(t("customer"), "c_acctbal", epsilon=1.0, low=0, high=10_000)


@query("order_token", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal)::INTEGER AS r FROM customer")
def _(t):
    from pyspark.sql import Window

    rows = t("customer").select("c_custkey", "c_nationkey", privacy.order_token("c_acctbal").alias("token"))
    return rows.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("token")).alias("r"))


MERKLE = " ".join(f", l{i + 1} AS MATERIALIZED (SELECT pos // 2 AS pos, CASE WHEN (SELECT count(*) FROM l{i}) = 1 THEN min(hash) ELSE sha256(unhex(arg_min(hash, pos) || arg_max(hash, pos))) END AS hash FROM l{i} GROUP BY 1)" for i in range(24))


@query("merkle_root", f"WITH l0 AS MATERIALIZED (SELECT o_orderkey AS pos, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS hash FROM orders) {MERKLE} SELECT hash AS root FROM l24")
def _(t):
    return integrity.merkle_root(t("orders").select(F.col("o_orderkey").alias("pos"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("hash")))


def _chained(t):
    return integrity.chain(t("events"), by=["user_id"], order=["ts", "event_id"], payload=F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))


@query("hash_chain", """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id || '|' || event_type AS payload FROM events),
c AS (SELECT user_id, seq, sha256(repeat('0', 64) || payload) AS hash FROM e WHERE seq = 0 UNION ALL SELECT e.user_id, e.seq, sha256(c.hash || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT user_id, seq::INTEGER AS seq, hash FROM c""")
def _(t):
    return _chained(t).select("user_id", "seq", "hash")


@query("hash_chain_verify", "SELECT 3::BIGINT AS user_id, 0::INTEGER AS seq UNION ALL SELECT 3::BIGINT, 1")
def _(t):
    broken = _chained(t).withColumn("hash", F.when((F.col("user_id") == 3) & (F.col("seq") == 0), F.lit("0" * 64)).otherwise(F.col("hash")))
    return integrity.chain_breaks(graph.checkpointed(broken), by=["user_id"]).select("user_id", "seq")


@query("invariants", "SELECT 0::BIGINT AS orphans, count(*) AS missing, false AS ok FROM orders WHERE o_orderkey % 100 = 7")
def _(t):
    return integrity.invariants(t("orders").select("o_orderkey"), t("orders").where("o_orderkey % 100 <> 7").select("o_orderkey"), key="o_orderkey")


@query("manifest")
def _(t):
    return integrity.manifest(t("orders"), key="o_orderkey")


# Sources and sinks.
def _folder(t, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{graph.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("ndjson_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _(t):
    path = _folder(t, "ndjson")
    writers.Transfer(t.spark).from_collection(t("customer").select("c_custkey", "c_name", "c_acctbal"), {"c_acctbal": {"$gt": 5000}}).to_ndjson(path).run()
    return readers.ndjson(t.spark, path, schema="c_custkey long, c_name string, c_acctbal double")


@query("csv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ' \"q\", x' AS p_name FROM part")
def _(t):
    path = _folder(t, "csv")
    writers.write_csv(t("part").select("p_partkey", F.concat("p_name", F.lit(' "q", x')).alias("p_name")), path)
    return readers.csv(t.spark, path)


@query("collection_copy", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    path = _folder(t, "copy")
    writers.copy(t("orders"), path, {"o_orderstatus": "P"})
    return t.spark.read.parquet(path)


@query("blob_chunks", """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), p AS (SELECT substr(h, (i * 4096 + 1)::BIGINT, 4096) AS c FROM b, unnest(range(0, (length(h) - 1) // 4096 + 1)) AS u(i))
SELECT count(*) AS refs, count(DISTINCT c) AS chunks FROM p""")
def _(t):
    refs, chunks = writers.blob_chunks(t("documents"), key="doc_id", data="text", size=2048)  # most texts are far under the default of 64 KiB
    return refs.agg(F.count(F.lit(1)).alias("refs")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


RING = ", ".join(f"({p}, '{n}')" for p, n in writers.ring(["n1", "n2", "n3"]))


@query("shard_ring", f"""
WITH r(p, n) AS (VALUES {RING}), h AS (SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT AS h FROM orders)
SELECT o_orderkey, coalesce((SELECT arg_min(n, p) FROM r WHERE p >= h), (SELECT arg_min(n, p) FROM r)) AS shard FROM h""")
def _(t):
    return t("orders").select("o_orderkey", writers.shard_of(F.col("o_orderkey"), ["n1", "n2", "n3"]).alias("shard"))


@query("generate_users")
def _(t):
    return readers.generate_users(t.spark, 1000)


# Streams.
def _stream(t):
    return streams.read_stream(t.spark, f"{t.folder}/events.parquet*", t("events").schema)


def _drained(t, df, name: str, mode: str = "append"):
    path = _folder(t, name)
    streams.drain(df, path, _folder(t, f"{name}-state"), mode=mode)
    return t.spark.read.schema(df.schema).parquet(path)


@query("change_stream", "SELECT event_id AS id, 'insert' AS operationType, sha256('seq:' || event_id) AS resumeToken FROM events WHERE event_type = 'purchase' AND value > 20")
def _(t):
    changes = _stream(t).withColumns({"seq": F.col("event_id"), "op": F.lit("insert"), "id": F.col("event_id")})
    out = streams.watch(changes, {"event_type": "purchase", "value": {"$gt": 20}}, ["insert"]).select("id", "operationType", "resumeToken")
    return _drained(t, out, "changes")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS windowStart, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(t):
    df = _stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.tumbling(df, "ts", "1 day", [F.count(F.lit(1)).alias("n")], late="1 hour")
    return _drained(t, out, "tumbling").select(F.col("windowStart").cast(T.TimestampNTZType()).alias("windowStart"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def _(t):
    return _drained(t, streams.deduplicate(_stream(t).select("user_id"), ["user_id"]), "dedup")


@query("stream_rate_limit")
def _(t):
    calls = _stream(t).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return _drained(t, streams.rate_limit(calls, "user_id", "ms", capacity=2, refill=0.0001), "limits")


@query("stream_batch_audit", "SELECT count(*) AS n FROM events")
def _(t):
    path = _folder(t, "audit")
    streams.for_each_batch(_stream(t).select("event_id"), lambda df, i: df.agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path), _folder(t, "audit-state"))
    return t.spark.read.parquet(path).agg(F.sum("n").alias("n"))


@query("presence_sessions", """
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS beats
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(t):
    return streams.presence_sessions(t("events"), "ts", "user_id", "2 hours")


