"""Merkle trees, hash chains and collection invariants."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

EMPTY_ROOT = hashlib.sha256(b"empty").hexdigest()


def _parent(children: Column) -> Column:
    """Hash of two child hashes; an odd one is paired with itself."""
    pair = F.transform(F.sort_array(children), lambda x: x["hash"])
    return F.sha2(F.unhex(F.concat(F.element_at(pair, 1), F.element_at(pair, -1))), 256)


def merkle_levels(leaves: DataFrame, *, position: str = "pos", leaf: str = "hash") -> list[DataFrame]:
    """(pos, hash) of every level, leaves first; each level is half the one below it."""
    level = checkpointed(leaves.select(F.col(position).cast("long").alias("pos"), F.col(leaf).alias("hash")))
    out, n = [level], level.count()
    while n > 1:
        level = checkpointed(level.groupBy(F.floor(F.col("pos") / 2).alias("pos")).agg(_parent(F.collect_list(F.struct("pos", "hash"))).alias("hash")))
        out.append(level)
        n = -(-n // 2)
    return out


def merkle_root(leaves: DataFrame, *, position: str = "pos", leaf: str = "hash", height: int = 12) -> DataFrame:
    """One row: root.  Positions are 0 to n - 1.  Aligned subtrees of 2**height leaves are hashed in one go each, so a job rises ``height`` levels."""
    level = leaves.select(F.col(position).cast("long").alias("pos"), F.col(leaf).alias("hash"))
    n = level.count()
    while n > 1:
        up = min(height, (n - 1).bit_length())

        def subtree(key, table):
            level = [bytes.fromhex(h) for h in table.sort_by("pos")["hash"].to_pylist()]
            for _ in range(up):
                level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
            return pa.table({"pos": [key[0].as_py()], "hash": [level[0].hex()]})

        level = checkpointed(level.withColumn("_tree", F.shiftright("pos", up)).groupBy("_tree").applyInArrow(subtree, "pos long, hash string"))
        n = -(-n >> up)
    return level.agg(F.coalesce(F.max("hash"), F.lit(EMPTY_ROOT)).alias("root"))


def merkle_proof(leaves: DataFrame, at: int, **options) -> list[tuple[str, str]]:
    """(side, hash) of the siblings from leaf to root."""
    proof, levels = [], merkle_levels(leaves, **options)
    for level in levels[:-1]:
        sibling = at ^ 1
        row = level.where(F.col("pos") == sibling).first() or level.where(F.col("pos") == at).first()
        proof.append(("left" if at % 2 else "right", row["hash"]))
        at //= 2
    return proof


def merkle_verify(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    for side, other in proof:
        a, b = (other, leaf) if side == "left" else (leaf, other)
        leaf = hashlib.sha256(bytes.fromhex(a + b)).hexdigest()
    return leaf == root


def chain(df: DataFrame, *, by: list[str], order: list[str], payload: Column, start: str = "0" * 64) -> DataFrame:
    """(by, seq, payload, prev, hash): each row's hash covers the one before it.

    The fold runs within one group, so independent chains are parallel; a chain's rows must fit an executor.
    """
    gathered = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, payload.alias("_payload")))).alias("_all"))
    first = F.struct(F.lit(start).alias("last"), F.array().cast("array<struct<prev:string,hash:string>>").alias("out"))

    def step(s, x):
        h = F.sha2(F.concat(s["last"], x["_payload"]), 256)
        return F.struct(h.alias("last"), F.concat(s["out"], F.array(F.struct(s["last"].alias("prev"), h.alias("hash")))).alias("out"))

    zipped = gathered.select(*by, "_all", F.aggregate("_all", first, step)["out"].alias("_h"))
    rows = zipped.select(*by, F.posexplode(F.arrays_zip("_all", "_h")).alias("seq", "_x"))
    return rows.select(*by, "seq", *(F.col(f"_x._all.{c}").alias(c) for c in order), F.col("_x._all._payload").alias("payload"), F.col("_x._h.prev").alias("prev"), F.col("_x._h.hash").alias("hash"))


def chain_breaks(df: DataFrame, *, by: list[str], start: str = "0" * 64) -> DataFrame:
    """Rows of a chain (by, seq, payload, prev, hash) whose hash or link is wrong."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(*by).orderBy("seq")), F.lit(start))
    return df.withColumn("_before", before).where((F.col("prev") != F.col("_before")) | (F.col("hash") != F.sha2(F.concat("prev", "payload"), 256))).drop("_before")


def manifest(df: DataFrame, *, key: str = "_id") -> DataFrame:
    """Row count and an order-independent digest of the rows."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def invariants(docs: DataFrame, index: DataFrame, *, key: str = "_id") -> DataFrame:
    """One row: index references without a document, documents without one, and whether the counts agree."""
    orphans = index.join(docs, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    missing = docs.join(index, key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    out = orphans.crossJoin(missing)  # two one-row tables
    return out.withColumn("ok", (F.col("orphans") == 0) & (F.col("missing") == 0))
