"""Filters, projections, order, pipelines, joins and query languages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.filters import find
from ..operators.pipeline import aggregate
from ..operators.query import Collection, after
from . import commands, graphql, nlq, sqlfront
from .registry import query

ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _items(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# Scans.
@query("scan_full", "SELECT * FROM orders")
def _(t):
    return find(t("orders"))


@query("find_point", "SELECT * FROM orders WHERE o_orderkey = 33")
def _(t):
    return Collection(t("orders"), "o_orderkey").find({"o_orderkey": 33}).to_df()


@query("find_ids", "SELECT * FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32)")
def _(t):
    return Collection(t("orders"), "o_orderkey").find_ids([1, 2, 3, 7, 32])


@query("find_compound", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    return find(t("orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("scan_range_buckets", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 15 AND 34")
def _(t):
    bucketed = t("part").withColumn("bucket", F.floor(F.col("p_size") / 10))
    return find(bucketed, {"bucket": {"$in": [1, 2, 3]}, "p_size": {"$gte": 15, "$lte": 34}}).select("p_partkey", "p_size")


@query("scan_ordered_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 ORDER BY o_orderkey LIMIT 1000")
def _(t):
    return Collection(t("orders"), "o_orderkey").find({"o_orderkey": {"$gte": 100, "$lte": 5000}}).sort("o_orderkey").limit(1000).select("o_orderkey o_totalprice").to_df()


@query("index_build_counts", "SELECT 'o_orderstatus' AS field, count(o_orderstatus) AS present FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders")
def _(t):
    from ..sources.writers import field_presence

    return field_presence(t("orders").select("o_orderstatus", "o_totalprice")).select("field", "present")


# Filters.
def _filter(name: str, table: str, spec, where: str, prepare=None, source: str | None = None):
    @query(name, f"SELECT * FROM {source or table} WHERE {where}")
    def _(t):
        df = t(table)
        return find(prepare(df) if prepare else df, spec)


def _nulls(df):
    return df.withColumn("n", F.nullif(F.col("p_size") % 7, F.lit(0)))


NULLS = "(SELECT *, nullif(p_size % 7, 0) AS n FROM part)"
_filter("find_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_filter("find_eq_null", "part", {"n": None}, "n IS NULL", _nulls, NULLS)
_filter("find_ne", "part", {"n": {"$ne": 3}}, "n IS DISTINCT FROM 3", _nulls, NULLS)
_filter("find_gt", "part", {"n": {"$gt": 3}}, "n > 3", _nulls, NULLS)
_filter("find_gte", "lineitem", {"l_quantity": {"$gte": 48}}, "l_quantity >= 48")
_filter("find_lt", "orders", {"o_totalprice": {"$lt": 20000}}, "o_totalprice < 20000")
_filter("find_lte", "part", {"n": {"$lte": 2}}, "n <= 2", _nulls, NULLS)
_filter("find_range", "orders", {"o_totalprice": {"$gte": 100000, "$lt": 120000}}, "o_totalprice >= 100000 AND o_totalprice < 120000")
_filter("find_in", "customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("find_nin", "part", {"n": {"$nin": [1, 2]}}, "n IS NULL OR n NOT IN (1, 2)", _nulls, NULLS)
_filter("find_exists", "part", {"n": {"$exists": True}}, "n IS NOT NULL", _nulls, NULLS)
_filter("find_type", "part", {"n": {"$type": "null"}, "p_size": {"$type": "number"}}, "n IS NULL", _nulls, NULLS)
_filter("find_regex", "part", {"p_name": {"$regex": "^[a-c].*e", "$options": "i"}}, "regexp_matches(lower(p_name), '^[a-c].*e')")
_filter("find_regex_literal", "customer", {"c_name": re.compile("1$")}, "regexp_matches(c_name, '1$')")
_filter("find_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3")
_filter("find_not", "part", {"n": {"$not": {"$gt": 3}}}, "NOT coalesce(n > 3, false)", _nulls, NULLS)
_filter("find_and", "lineitem", {"$and": [{"l_quantity": {"$gt": 45}}, {"l_discount": {"$lt": 0.02}}]}, "l_quantity > 45 AND l_discount < 0.02")
_filter("find_or", "lineitem", {"$or": [{"l_quantity": 1}, {"l_tax": 0.08}]}, "l_quantity = 1 OR l_tax = 0.08")
_filter("find_nor", "part", {"$nor": [{"n": {"$gt": 3}}, {"p_size": {"$lt": 10}}]}, "NOT (coalesce(n > 3, false) OR p_size < 10)", _nulls, NULLS)
_filter("find_or_empty", "nation", {"$or": []}, "false")
_filter("find_substring", "part", {"p_name": {"$substr": "re"}}, "contains(lower(p_name), 're')")

@query("find_dotted", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 1000")
def _(t):
    nested = t("customer").select("c_custkey", F.struct("c_name", F.struct("c_acctbal", "c_mktsegment").alias("more")).alias("c"))
    return find(nested, {"c.more.c_mktsegment": "BUILDING", "c.more.c_acctbal": {"$lt": 1000}}).select("c_custkey", "c.c_name")


def _arrays(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"), F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))


ARRAYS = "(SELECT l_orderkey, list_sort(list(l_linenumber)) AS lines, list({'q': l_quantity, 'f': l_returnflag}) AS items FROM lineitem GROUP BY 1)"


def _array_filter(name, spec, where):
    @query(name, f"SELECT l_orderkey, len(lines) AS n FROM {ARRAYS} WHERE {where}")
    def _(t):
        return find(_arrays(t), spec).select("l_orderkey", F.size("lines").cast("long").alias("n"))


_array_filter("find_size", {"lines": {"$size": 3}}, "len(lines) = 3")
_array_filter("find_all", {"lines": {"$all": [1, 4]}}, "list_has_all(lines, [1, 4])")
_array_filter("find_array_eq", {"lines": [1, 2]}, "lines = [1, 2]")
_array_filter("find_array_in", {"lines": {"$in": [6, 7]}}, "list_has_any(lines, [6, 7])")
_array_filter("find_elem_match", {"items": {"$elemMatch": {"l_quantity": {"$gte": 49}, "l_returnflag": "R"}}}, "len(list_filter(items, lambda x: x.q >= 49 AND x.f = 'R')) > 0")
_array_filter("find_elem_match_scalar", {"lines": {"$elemMatch": {"$gt": 5, "$lt": 7}}}, "list_contains(lines, 6)")


@query("find_fuzzy", "SELECT p_partkey, p_name FROM part WHERE levenshtein(lower(p_name), 'red') <= 1 OR contains(lower(p_name), 'red') OR len(list_filter(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'red') <= 1)) > 0")
def _(t):
    return find(t("part"), {"p_name": {"$fuzzy": "red"}}).select("p_partkey", "p_name")


SOUNDEX = """
SELECT k, n, CASE WHEN u = '' THEN '' ELSE u[1] || rpad(array_to_string(list_filter([CASE WHEN c[i] <> '0' AND c[i] <> c[i - 1] THEN c[i] ELSE '' END FOR i IN range(2, len(c) + 1)], lambda x: x <> ''), '')[1:3], 3, '0') END AS code
FROM (SELECT k, n, u, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c FROM (SELECT n_nationkey AS k, n_name AS n, regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS u FROM nation))
"""


@query("fn_soundex", f"SELECT k AS n_nationkey, n AS n_name, code FROM ({SOUNDEX})")
def _(t):
    from ..functions.scalars import soundex

    return t("nation").select("n_nationkey", "n_name", soundex("n_name").alias("code"))


@query("find_soundex", f"SELECT * FROM nation WHERE n_nationkey IN (SELECT k FROM ({SOUNDEX}) WHERE code = 'N350')")
def _(t):
    return find(t("nation"), {"n_name": {"$soundex": "NATION"}})


# Projections, order, paging.
@query("select_inclusive", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    return Collection(t("part"), "p_partkey").find().select("p_name p_size").to_df()


@query("select_exclusive", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part")
def _(t):
    return Collection(t("part"), "p_partkey").find().select({"p_name": 0, "p_size": 0}).to_df()


@query("filter_outside_projection", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return Collection(t("orders"), "o_orderkey").find({"o_orderstatus": "P"}).select("o_orderkey").to_df()


@query("virtual_getter", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE round(l_extendedprice * (1 - l_discount), 4) > 90000")
def _(t):
    from .model import Model

    model = Model(t("lineitem"), key="l_orderkey", virtuals={"net": lambda df: F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)})
    return model.find({"net": {"$gt": 90000}}).select({"l_orderkey": 1, "l_linenumber": 1, "net": 1}).to_df()


@query("sort_multi", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 50")
def _(t):
    return Collection(t("part"), "p_partkey").find().sort("-p_size p_retailprice").limit(50).select("p_size p_retailprice").to_df()


@query("skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(t):
    return Collection(t("orders"), "o_orderkey").find().sort({"o_totalprice": -1}).skip(20).limit(10).select("o_totalprice").to_df()


@query("topk", f"SELECT {ITEM} FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def _(t):
    return _items(t("lineitem")).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("sort_nulls_last", "SELECT p_partkey, n FROM (SELECT p_partkey, nullif(p_size % 7, 0) AS n FROM part) ORDER BY n DESC NULLS LAST, p_partkey LIMIT 100")
def _(t):
    return Collection(_nulls(t("part")).select("p_partkey", "n"), "p_partkey").find().sort({"n": -1}).limit(100).to_df()


@query("paginate_keyset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 OR (o_totalprice = 150000 AND o_orderkey > 10) ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(t):
    df = t("orders").select("o_orderkey", "o_totalprice")
    return df.where(after(df, "o_totalprice", "o_orderkey", 150000.0, 10)).orderBy("o_totalprice", "o_orderkey").limit(20)


# Pipelines.
@query("group_basic", "SELECT l_returnflag AS _id, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1 ORDER BY revenue DESC LIMIT 10")
def _(t):
    import datetime

    out = aggregate(t("lineitem"), [
        {"$match": {"l_shipdate": {"$lt": datetime.datetime(1998, 9, 2)}}}, {"$group": {"_id": "$l_returnflag", "revenue": {"$sum": "$l_extendedprice"}, "n": {"$sum": 1}}},
        {"$sort": {"revenue": -1}}, {"$limit": 10},
    ])
    return out.select("_id", F.round("revenue", 2).alias("revenue"), F.col("n").cast("long").alias("n"))


@query("group_global", "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _(t):
    return aggregate(t("orders"), [{"$group": {"_id": None, "n": {"$count": {}}, "low": {"$min": "$o_totalprice"}, "high": {"$max": "$o_totalprice"}}}])


@query("group_null_avg", "SELECT p_brand AS _id, round(sum(coalesce(nullif(p_size % 7, 0), 0)) / count(*)::DOUBLE, 6) AS mean FROM part GROUP BY 1")
def _(t):
    out = aggregate(_nulls(t("part")), [{"$group": {"_id": "$p_brand", "mean": {"$avg": "$n"}}}])
    return out.select("_id", F.round("mean", 6).alias("mean"))


@query("group_compound", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    out = aggregate(t("lineitem"), [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$count": {}}}}])
    return out.select("_id.flag", "_id.status", "n")


@query("match_after_group", "SELECT o_custkey AS _id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 15")
def _(t):
    return aggregate(t("orders"), [{"$match": {"o_orderstatus": {"$ne": "P"}}}, {"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 15}}}])


@query("lookup_array", "SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    out = aggregate(t("customer"), [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found", "fields": ["o_orderkey", "o_totalprice"]}}], {"orders": t("orders")})
    return out.select("c_custkey", F.size("found").cast("long").alias("orders"), F.round(F.aggregate("found", F.lit(0.0), lambda s, x: s + x["o_totalprice"]), 2).alias("total"))


@query("lookup_single", "SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    out = joins.lookup(t("customer"), t("orders"), "c_custkey", "o_custkey", "found", single=True, first_by="o_orderkey")
    return out.select("c_custkey", F.col("found.o_orderkey").alias("first_order"))


@query("populate", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    nations = joins.lookup(t("nation"), t("region"), "n_regionkey", "r_regionkey", "region", single=True)
    out = Collection(t("supplier"), "s_suppkey").find().populate("s_nationkey", nations, "n_nationkey", "nation", single=True).to_df()
    return out.select("s_suppkey", "nation.n_name", "nation.region.r_name")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    rich = find(t("orders"), {"o_totalprice": {"$gt": 300000}}).select(F.col("o_custkey").alias("c_custkey"))
    return joins.join(t("customer"), rich, "c_custkey", "semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return joins.join(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "anti").select("c_custkey")


@query("unwind", "SELECT l_orderkey, l_linenumber AS line FROM lineitem")
def _(t):
    return joins.unwind(_arrays(t).select("l_orderkey", F.col("lines").alias("line")), "$line")


@query("unwind_empty", "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_size END AS a FROM part WHERE p_size % 3 <> 0")
def _(t):
    a = F.when(F.col("p_size") % 3 == 1, F.array("p_size")).when(F.col("p_size") % 3 == 2, F.array().cast("array<int>"))
    return joins.unwind(t("part").select("p_partkey", a.alias("a")), "a")


@query("add_fields", "SELECT r_regionkey, r_name, 'USD' AS currency, 2 AS level FROM region")
def _(t):
    return aggregate(t("region"), [{"$addFields": {"currency": "USD", "level": 2}}])


@query("project_stage", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return aggregate(t("nation"), [{"$project": {"n_name": 1}}], key="n_nationkey")


@query("pipeline_extended", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 1000 OFFSET 5)")
def _(t):
    return aggregate(t("part"), [{"$group": {"_id": "$p_brand"}}, {"$sort": {"_id": 1}}, {"$skip": 5}, {"$limit": 1000}, {"$count": "n"}])


@query("replace_root", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return aggregate(t("orders").select(F.struct("o_orderkey", "o_totalprice").alias("d")), [{"$replaceRoot": {"newRoot": "$d"}}])


@query("grouping_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return aggregate(t("lineitem"), [{"$groupingSets": {"keys": ["l_returnflag", "l_linestatus"], "n": {"$count": {}}}}])


@query("group_min_max_text", "SELECT c_mktsegment AS _id, min(c_name) AS first_name, max(c_name) AS last_name FROM customer GROUP BY 1")
def _(t):
    return aggregate(t("customer"), [{"$group": {"_id": "$c_mktsegment", "first_name": {"$min": "$c_name"}, "last_name": {"$max": "$c_name"}}}])


@query("group_push_set", "SELECT o_custkey AS _id, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def _(t):
    out = aggregate(t("orders"), [{"$group": {"_id": "$o_custkey", "all": {"$push": "$o_orderkey"}, "kinds": {"$addToSet": "$o_orderstatus"}}}])
    return out.select("_id", F.size("all").cast("long").alias("n"), F.size("kinds").cast("long").alias("kinds"))


@query("revenue_by_nation", """
SELECT n_name AS _id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    nation = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(nation, F.col("o_custkey") == F.col("c_custkey"))
    out = aggregate(rows.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), [{"$group": {"_id": "$n_name", "revenue": {"$sum": "$net"}}}])
    return out.select("_id", F.round("revenue", 2).alias("revenue"))


# Sets.
def _members(t):
    return {"big": find(t("orders"), {"o_totalprice": {"$gte": 200000}}), "small": find(t("orders"), {"o_totalprice": {"$lt": 50000}})}


MEMBERS = "(SELECT *, 'big' AS _source FROM orders WHERE o_totalprice >= 200000 UNION ALL SELECT *, 'small' FROM orders WHERE o_totalprice < 50000)"


@query("federated_union", f"SELECT * FROM {MEMBERS} WHERE o_orderstatus = 'F'")
def _(t):
    return joins.federated(_members(t), {"o_orderstatus": "F"})


@query("federated_sort_limit", f"SELECT * FROM {MEMBERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(t):
    return joins.federated(_members(t), sort={"o_totalprice": -1, "o_orderkey": 1}, limit=30)


@query("federated_count", f"SELECT count(*) AS n FROM {MEMBERS}")
def _(t):
    return joins.federated(_members(t)).agg(F.count(F.lit(1)).alias("n"))


@query("ids_intersect", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity = 50")
def _(t):
    return joins.intersect_ids([find(t("orders"), {"o_orderstatus": "O"}), find(t("lineitem"), {"l_quantity": 50}).select(F.col("l_orderkey").alias("o_orderkey"))], "o_orderkey")


@query("ids_union", "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 50")
def _(t):
    return joins.union_ids([find(t("orders"), {"o_totalprice": {"$lt": 2000}}), find(t("lineitem"), {"l_quantity": 50}).select(F.col("l_orderkey").alias("o_orderkey"))], "o_orderkey")


# Languages.
@query("sql_basic", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC LIMIT 20 OFFSET 5")
def _(t):
    return sqlfront.execute(t.spark, "SELECT c_custkey, c_acctbal FROM customer_view WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC LIMIT 20 OFFSET 5", {"customer_view": t("customer")})


@query("sql_like", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def _(t):
    return sqlfront.execute(t.spark, "SELECT p_partkey, p_name FROM part_view WHERE p_name LIKE '%AN%'", {"part_view": t("part")})


@query("graphql_basic", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name LIMIT 3")
def _(t):
    return graphql.execute('{ nations(limit: 3, sort: "n_name", where: {n_regionkey: 2}) { n_name missing } }', {"nations": t("nation")})["nations"]


@query("nl_top", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    return nlq.query(t("customer"), "Top 10 customers with c_acctbal > 5000", "c_custkey").to_df().select("c_custkey", "c_acctbal")


@query("nl_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 18 AND 25")
def _(t):
    return nlq.query(t("part").select("p_partkey", "p_size"), "p_size entre ١٨ y 25", "p_partkey").to_df()


@query("command_find", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0 ORDER BY s_suppkey")
def _(t):
    return commands.run_command({"s": t("supplier")}, {"find": "s", "filter": {"s_acctbal": {"$lt": 0}}, "sort": {"s_suppkey": 1}, "projection": {"s_suppkey": 1, "s_name": 1}}, "s_suppkey")["cursor"]["firstBatch"]


@query("command_aggregate", "SELECT o_orderpriority AS _id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    return commands.run_command({"o": t("orders")}, {"aggregate": "o", "pipeline": [{"$match": {"o_orderstatus": "F"}}, {"$group": {"_id": "$o_orderpriority", "n": {"$count": 1}}}]}, "o_orderkey")["cursor"]["firstBatch"]


@query("variant_filter", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50 AND event_type = 'click'")
def _(t):
    df = t("events").select("event_id", F.parse_json(F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("p")))).alias("doc"))
    return find(df, {"doc.p.k": {"$gte": 50}, "doc.event_type": "click"}).select("event_id")
