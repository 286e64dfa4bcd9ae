"""Plumbing shared by the corpus operators: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder, sized, written  # noqa: F401

#: Rows up to which a side of a join that has one integer a row is broadcast.
BROADCAST_IDS = 1_000_000
#: Bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc

    def _trim(pad: int) -> None:
        pass



def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset and all run in this process."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From here on the session's Arrow batches have at most ``most`` bytes (a smaller setting stays).

    JVM and worker both hold a batch whole, beside the JVM's heap, and hardly give that memory back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory back to the system: workers are used again, and what one keeps counts in the next stage too."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow for a function of one batch; the function may yield any number of batches.  ``done`` is called after the last."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        batch = None
        if done:
            done()
        release()

    return df.mapInArrow(run, schema)


def without_ids(docs: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key isn't in ``removed`` (a written table with the one column); null keys stay."""
    gone = sized(removed.select(F.col(key).alias("__gone_key")).distinct(), BROADCAST_IDS)
    return docs.join(gone, docs[key] == gone["__gone_key"], "left_anti")
