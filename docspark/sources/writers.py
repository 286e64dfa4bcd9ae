"""Sinks, copies, bundles, blobs and shard placement."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import find
from . import readers


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def csv_columns(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Columns as a CSV has them: nested values as JSON, nulls empty."""
    out = []
    for name in fields or df.columns:
        kind = df.schema[name].dataType
        value = F.to_json(name) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.col(f"`{name}`").cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "overwrite") -> None:
    """A header, every value quoted, quotes doubled."""
    csv_columns(df, fields).write.mode(mode).options(header=True, quoteAll=True, quote='"', escape='"', emptyValue="").csv(path)


def copy(df: DataFrame, path: str, spec: dict | None = None, mode: str = "append") -> None:
    """Rows that match, appended to a Parquet table."""
    find(df, spec).write.mode(mode).parquet(path)


@dataclass
class Transfer:
    """source -> filter -> destination: Transfer(spark).from_ndjson(p).where({...}).to_parquet(q).run()."""

    spark: SparkSession
    df: DataFrame | None = None
    steps: list = field(default_factory=list)

    def from_parquet(self, path: str) -> Transfer:
        self.df = self.spark.read.parquet(path)
        return self

    def from_ndjson(self, path: str, mode: str = "fail") -> Transfer:
        self.df = readers.ndjson(self.spark, path, mode=mode)
        return self

    def from_csv(self, path: str) -> Transfer:
        self.df = readers.csv(self.spark, path)
        return self

    def from_collection(self, df: DataFrame, spec: dict | None = None) -> Transfer:
        self.df = find(df, spec)
        return self

    def where(self, spec: dict) -> Transfer:
        self.df = find(self.df, spec)
        return self

    def to_parquet(self, path: str, mode: str = "append") -> Transfer:
        self.steps.append(lambda df: df.write.mode(mode).parquet(path))
        return self

    def to_ndjson(self, path: str) -> Transfer:
        self.steps.append(lambda df: write_ndjson(df, path))
        return self

    def to_csv(self, path: str) -> Transfer:
        self.steps.append(lambda df: write_csv(df, path))
        return self

    def run(self) -> None:
        for step in self.steps:
            step(self.df)


def write_bundle(tables: dict[str, DataFrame], root: str, *, name: str | None = None) -> str:
    """A dataset folder (an absolute path or a URI) with a manifest of rows and schemas; it is complete once the manifest is there."""
    path = f"{root}/{name or time.strftime('%Y%m%dT%H%M%S')}"
    manifest = {}
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{table}.parquet")
        manifest[table] = {"rows": df.sparkSession.read.parquet(f"{path}/{table}.parquet").count(), "schema": json.loads(df.schema.json())}
    body = json.dumps(manifest, sort_keys=True)
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{base}/_MANIFEST.json") as out:
        out.write(json.dumps({"tables": manifest, "sha256": hashlib.sha256(body.encode()).hexdigest()}).encode())
    return path


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; a manifest that doesn't match its digest raises."""
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/_MANIFEST.json") as held_file:
        held = json.loads(held_file.read())
    if hashlib.sha256(json.dumps(held["tables"], sort_keys=True).encode()).hexdigest() != held["sha256"]:
        raise ValueError(f"bundle {path} has a broken manifest")
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in held["tables"]}


def blob_chunks(df: DataFrame, *, key: str, data: str, size: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(key, seq, hash) references and (hash, data) chunks, each content once."""
    n = F.octet_length(F.col(data))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    binary = F.col(data).cast("binary")
    pieces = df.select(key, F.posexplode(F.transform(starts, lambda i: F.substring(binary, i, F.lit(size)))).alias("seq", "data")).withColumn("hash", F.sha2("data", 256))
    return pieces.select(key, "seq", "hash"), pieces.select("hash", "data").dropDuplicates(["hash"])


def blob_restore(refs: DataFrame, chunks: DataFrame, *, key: str) -> DataFrame:
    """(key, data) from references and chunks."""
    joined = refs.join(chunks, "hash").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("_p"))
    return joined.select(key, F.aggregate("_p", F.lit(b""), lambda s, x: F.concat(s, x["data"])).alias("data"))


def ring(nodes: list[str], virtual: int = 64) -> list[tuple[int, str]]:
    """(position, node) of a hash ring: 32-bit MD5 prefixes of the nodes' virtual names."""
    return sorted((int(hashlib.md5(f"{n}#{v}".encode()).hexdigest()[:8], 16), n) for n in nodes for v in range(virtual))


def shard_of(key: Column, nodes: list[str], virtual: int = 64) -> Column:
    """The node of a key: the first on the ring at or after its hash, else the first of all."""
    points = ring(nodes, virtual)
    steps = [1 << i for i in reversed(range(len(points).bit_length()))]
    spots = F.lit([p for p, _ in points] + [1 << 32] * (2 * steps[0] - 1 - len(points)))
    names = F.lit([n for _, n in points + points[:1]])
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    # A binary search; the hash is bound to a variable, as an expression in a lambda is computed at every step.
    search = lambda x: F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(F.get(spots, at + step - 1) < x, step).otherwise(0))
    return F.get(F.transform(F.array(h), lambda x: F.get(names, search(x))), F.lit(0))


def field_presence(df: DataFrame) -> DataFrame:
    """(field, present, distinct): rows with each field, and about how many values it has."""
    counted = df.agg(*(F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(df.columns)), *(F.approx_count_distinct(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(df.columns)))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("present"), F.col(f"d_{i}").alias("distinct")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")
