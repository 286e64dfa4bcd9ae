"""Operator 7: sharding by proportional stratified interleaving.

Rows are ranked within their source in the order of a seeded shuffle (the MD5
of seed and key).  Row r of a source of n rows has fractional rank
(r - 1/2) / n.  All rows sorted by fractional rank, ties by source, give the
global position; ``shards`` equal cuts of it give the shards, so every shard
holds each source in the proportion of the whole, to within one row.

Ranks need no single sort: rows are cut into buckets by shuffle order, ranked
within (source, bucket), and offset by the bucket's cumulative count, so a hot
source is as parallel as any.  Rows move once.  With up to ``MOST_SOURCES``
sources the position follows from the counts in closed form; with more, a
second bucketed ranking sorts by fractional rank.  Both give the same result.

A null source is a stratum of its own, before all others.  Null keys shuffle
like any key.  Rows with equal keys are ordered by text; equal rows are
interchangeable.  An empty table gives no rows.  The result has all columns of
the input and ``position`` and ``shard``, which replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

MOST_SOURCES = 1000
BUCKET_ROWS = 2_000
ORACLE = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''))), text NULLS FIRST) AS r, count(*) OVER (PARTITION BY source) AS n
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n)::DOUBLE, source NULLS FIRST) - 1 AS position, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, text, lang, source, n_chars, position, CAST(position * 64 // total AS INTEGER) AS shard FROM placed
"""


def _rank(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1-based rank of each row within ``by``; ``bucket`` is monotone in ``order``."""
    rows = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*(f"_b_{c}" for c in by)).orderBy("_b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_bucket").alias("_b_bucket"), "_n")
    offsets = written(counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "shard-offsets")
    on = F.col("_bucket") == F.col("_b_bucket")
    for c in by:
        on &= F.col(c) == F.col(f"_b_{c}")
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    ranked = rows.withColumn("_local", local).join(sized(offsets), on)
    return ranked.withColumn(name, F.col("_local") + F.col("_offset")).drop("_bucket", "_b_bucket", "_local", "_offset", *(f"_b_{c}" for c in by))


def shard(docs: DataFrame, *, shards: int = 64, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", most_sources: int = MOST_SOURCES) -> DataFrame:
    """All rows with their ``position`` and ``shard``."""
    columns = [c for c in docs.columns if c not in ("position", "shard")]
    stratum = F.when(F.col(source).isNotNull(), F.concat(F.lit("="), F.col(source))).otherwise("")
    sizes = written(docs.groupBy(stratum.alias("_s")).agg(F.count(F.lit(1)).alias("_n")), "shard-sizes")
    strata, total, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).first()
    if not total:
        return docs.select(*columns, F.lit(0).cast("long").alias("position"), F.lit(0).alias("shard"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    buckets = min(1 << 24, 1 << math.ceil(math.log2(max(1, most / BUCKET_ROWS))))
    first = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    rows = docs.select(F.struct(*columns).alias("_row"), stratum.alias("_stratum"), hashed.alias("_hash"))
    rows = _rank(rows, ["_stratum"], F.floor(first * buckets / (1 << 32)).cast("int"), [F.col("_hash"), F.col(f"_row.{text}").asc_nulls_first()], "_rank")
    rows = rows.join(sized(sizes), F.col("_stratum") == F.col("_s"))
    if strata <= most_sources:
        known = sorted((r["_s"], r["_n"]) for r in sizes.collect())
        kind = "decimal(38,0)" if 2 * most * most >= 1 << 62 else "bigint"
        a = f"((2 * CAST(_rank AS {kind}) - 1) * x.n)"
        ahead = f"CASE WHEN x.s < _stratum THEN ({a} div _n + 1) div 2 ELSE ({a} + _n - 1) div _n div 2 END"
        literal = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).cast(kind).alias("n")) for s, n in known))
        rows = rows.withColumn("_sizes", literal).withColumn("position", F.expr(f"aggregate(_sizes, 0L, (t, x) -> t + {ahead})"))
    else:
        share = (2 * F.col("_rank") - 1) / (2 * F.col("_n"))
        cuts = max(1, total // BUCKET_ROWS)
        rows = _rank(rows.withColumn("_share", share).withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_share") * cuts).cast("long"), [F.col("_share"), F.col("_stratum")], "_place")
        rows = rows.withColumn("position", (F.col("_place") - 1).cast("long"))
    return rows.select("_row.*", "position", F.floor(F.col("position") * shards / F.lit(total)).cast("int").alias("shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard, each in order of position."""
    sharded.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
