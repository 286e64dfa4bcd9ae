"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, tokenisation.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its rows as
Parquet in the shared folder and rereads them as the next stage's documents.
All but the last stage return the columns of documents.

SQL can't express the SimHash, MinHash and zstandard stages, so there is no
oracle; the tests hold each stage against a brute-force version.

Stages judge rows, not ids: of rows that share a doc_id only those go whose own
text is a near duplicate or holds an item.  Rows without a doc_id are judged
like any other.  Rows that repeat both doc_id and text count as copies, of which
near-dedup keeps one.

Each stage bounds the session's Arrow batches (``bounded_batches``), and leaves
it so: the rows it returns are computed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, decontaminate, language_id, secrets, simhash
from docspark.llm.common import bounded_batches, sized, without_ids, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language, under that language."""
    bounded_batches(spark)
    columns = docs.columns
    marked = docs.withColumn("__row_hash", F.xxhash64("text", "lang", "source"))
    evidence = language_id.document_evidence(docs).withColumn("__row_hash", F.xxhash64("text", "declared", "host"))
    judged = language_id.classify(evidence.withColumn("__declared", F.col("declared")), ["doc_id", "__row_hash", "__declared"])
    changes = judged.where(F.col("lang").isNull() | ~F.col("lang").eqNullSafe(F.col("__declared"))).select(F.col("doc_id").alias("__id"), F.col("__row_hash").alias("__hash"), F.col("lang").alias("__new"), F.lit(True).alias("__changed")).distinct()
    changes = sized(written(changes, "language-changes"))
    out = marked.join(changes, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash")), "left")
    out = out.where(F.col("__changed").isNull() | F.col("__new").isNotNull()).withColumn("lang", F.coalesce("__new", "lang"))
    return out.select(*columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a ``__key``, equal for rows of equal doc_id and text only, and the keys that several rows have.

    The key is the doc_id where all its rows have one text; else, and without a doc_id, a hash of doc_id and text above
    2**62.  A hash that stands for different rows is told by a second one; such rows have no key and are never removed.
    """
    hashed = docs.withColumn("__text", F.xxhash64("text", F.lit(1)))
    several = hashed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), (F.min("__text") != F.max("__text")).alias("__mixed")).where("__n > 1")
    several = written(several, "pipeline-repeated-ids")
    mixed = sized(several.where("__mixed").select("__id", F.lit(True).alias("__differs")))
    own = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    rows = hashed.join(mixed, F.col("doc_id") == F.col("__id"), "left")
    rows = rows.withColumn("__key", F.when(F.col("doc_id").isNull() | F.col("__differs"), own).otherwise(F.col("doc_id").cast("long"))).drop("__id", "__differs")
    made = rows.where(F.col("__key") >= 1 << 62).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.coalesce("doc_id", F.lit(-1)), "__text")).alias("__a"), F.max(F.struct(F.coalesce("doc_id", F.lit(-1)), "__text")).alias("__b")).where("__n > 1")
    made = written(made.select("__key", (F.col("__a") != F.col("__b")).alias("__clash")), "pipeline-repeated-rows")
    clash = sized(made.where("__clash").select(F.col("__key").alias("__clash_key")))
    rows = rows.join(clash, F.col("__key") == F.col("__clash_key"), "left").withColumn("__key", F.when(F.col("__clash_key").isNull(), F.col("__key"))).drop("__clash_key", "__text")
    repeated = several.where(~F.col("__mixed")).select(F.col("__id").cast("long").alias("__key")).unionByName(made.where(~F.col("__clash")).select("__key"))
    return rows, repeated


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, and every document without near duplicates."""
    bounded_batches(spark)
    rows, repeated = keyed(docs)
    removed = written(simhash.near_duplicates(rows, key="__key").where(~F.col("keep")).select(F.col("doc_id").alias("__key")), "dedup-removed")
    kept = without_ids(rows, removed, "__key")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    repeated = sized(written(repeated, "dedup-repeated"))
    copies = kept.join(repeated, "__key", "left_semi")
    one = copies.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.struct("lang", "source", "n_chars")).alias("__row")).select("__row.*")
    return kept.join(repeated, "__key", "left_anti").select(*docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    rows, _ = keyed(docs)
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__key")
    return without_ids(rows, written(found.select(F.col("doc_id").alias("__key")).distinct(), "contaminated"), "__key").select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars to match."""
    bounded_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    bounded_batches(spark)
    return bpe.encode(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_redaction), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
