"""Sources: tables, NDJSON, federated members, and a generated table."""

from __future__ import annotations

import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """The folder's tables as temporary views."""
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def ndjson(spark: SparkSession, path: str, *, mode: str = "skip", schema=None) -> DataFrame:
    """One JSON document a line; blank lines are skipped.  mode: 'skip' drops bad lines, 'fail' raises, 'keep' keeps them in _corrupt_record."""
    how = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[mode]
    reader = spark.read.option("mode", how)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Schema-free documents: NDJSON lines as one VARIANT column ``doc``."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.try_parse_json("value").alias("doc")).where(F.col("doc").isNotNull())


def csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, **options).csv(path)


def latest_bundle(root: str) -> str | None:
    """The newest dataset folder of a bundle directory, by name."""
    fs, base = pafs.FileSystem.from_uri(root)
    folders = sorted((x.base_name for x in fs.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.Directory), reverse=True)
    found = next((x for x in folders if fs.get_file_info(f"{base}/{x}/_MANIFEST.json").type == pafs.FileType.File), None)
    return f"{root}/{found}" if found else None


def generate_users(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Synthetic users; row i is the same for a seed wherever it is made."""
    first = ["Ada", "Alan", "Barbara", "Donald", "Edsger", "Frances", "Grace", "John", "Ken", "Margaret"]
    last = ["Hopper", "Lovelace", "Liskov", "Knuth", "Dijkstra", "Allen", "Thompson", "McCarthy", "Hamilton"]
    city = ["Cairo", "Lagos", "Lima", "Oslo"]
    role = ["admin", "analyst", "editor", "engineer", "owner", "viewer"]
    pick = lambda values, salt: F.element_at(F.lit(values), (F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(len(values))) + 1).cast("int"))
    rows = spark.range(n).withColumns({"first": pick(first, "first"), "last": pick(last, "last")})
    return rows.select(
        F.concat(F.lit("user_"), F.col("id").cast("string")).alias("_id"), F.concat_ws(" ", "first", "last").alias("name"),
        F.concat(F.lower("first"), F.lit("."), F.lower("last"), F.col("id").cast("string"), F.lit("@example.org")).alias("email"),
        (18 + F.pmod(F.xxhash64("id", F.lit(f"{seed}:age")), F.lit(60))).cast("int").alias("age"), pick(city, "city").alias("city"), pick(role, "role").alias("role"),
        F.pmod(F.xxhash64("id", F.lit(f"{seed}:balance")), F.lit(10_000)).cast("int").alias("balance"),
    )
