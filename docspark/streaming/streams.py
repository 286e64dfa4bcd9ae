"""Structured Streaming: change streams, windows over late data, de-duplication, presence, rate limits.

Sources are file streams; every function takes and returns a streaming (or a
batch) DataFrame, so the same definition is tested against its batch result.
Delivery is exactly once per checkpoint; the checkpoint is the resume token.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import compile_filter


def read_stream(spark: SparkSession, path: str, schema, *, files: int | None = None) -> DataFrame:
    """New Parquet files under a path (a folder, or a glob of files)."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def _await(query, seconds: int | None) -> None:
    """Until the query ends; with a limit, it is stopped and raises beyond it."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream didn't end")


def drain(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", seconds: int | None = None) -> None:
    """Runs a query over what is there now, into Parquet, and ends."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    _await(query, seconds)


def drain_to_memory(df: DataFrame, name: str, *, mode: str = "append", seconds: int | None = None) -> DataFrame:
    """Runs a query over what is there now and gives its rows; for results that fit the driver."""
    query = df.writeStream.outputMode(mode).trigger(availableNow=True).format("memory").queryName(name).start()
    _await(query, seconds)
    return df.sparkSession.table(name)


def watch(changes: DataFrame, spec: dict | None = None, operations: list[str] | None = None) -> DataFrame:
    """Change events (seq, op, id, doc fields...) as a change stream: true operation types, a resume token, filtered on the document."""
    out = changes.where(F.col("op").isin(operations)) if operations else changes
    out = out.where(compile_filter(spec, out.schema)) if spec else out
    return out.withColumn("operationType", F.col("op")).withColumn("resumeToken", F.sha2(F.concat(F.lit("seq:"), F.col("seq").cast("string")), 256))


def tumbling(df: DataFrame, time: str, width: str, aggregations: list[Column], *, late: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Windowed aggregates; rows later than ``late`` are dropped, and a window is final then."""
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.window(time, width), *(by or [])).agg(*aggregations)
    return out.select(F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), *[c for c in out.columns if c != "window"])


def sliding(df: DataFrame, time: str, width: str, slide: str, aggregations: list[Column], *, late: str | None = None) -> DataFrame:
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.window(time, width, slide)).agg(*aggregations)
    return out.select(F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), *[c for c in out.columns if c != "window"])


def presence_sessions(df: DataFrame, time: str, user: str, gap: str = "10 seconds", *, late: str | None = None) -> DataFrame:
    """(user, start, end, beats): spans in which a user's heartbeats are at most ``gap`` apart."""
    if late:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("beats"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "beats")


def deduplicate(df: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """Each key once; with a watermark, state is kept for that long only."""
    if df.isStreaming and time and late:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def rate_limit(df: DataFrame, key: str, time_ms: str, *, capacity: float = 100, refill: float = 50) -> DataFrame:
    """(key, time, allowed): a token bucket a key; state is kept between batches."""
    kind, tkind = df.schema[key].dataType.simpleString(), df.schema[time_ms].dataType.simpleString()

    def step(k, batches, state):
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(time_ms)
        allowed = []
        for t in rows[time_ms]:
            if last is not None:
                tokens = min(capacity, tokens + max(0, t - last) / 1000 * refill)
            last = int(t) if last is None else max(last, int(t))
            allowed.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        state.update((float(tokens), last))
        yield pd.DataFrame({key: k[0], time_ms: rows[time_ms], "allowed": allowed})

    if df.isStreaming:
        return df.select(key, time_ms).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{time_ms}` {tkind}, allowed boolean", "tokens double, last long", "append", "NoTimeout")

    class Fresh:
        exists = False

        def update(self, value):
            pass

    def once(k, rows):
        return next(step(k, iter([rows]), Fresh()))

    return df.select(key, time_ms).groupBy(key).applyInPandas(once, f"`{key}` {kind}, `{time_ms}` {tkind}, allowed boolean")


def for_each_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: int | None = None) -> None:
    """A callback a micro-batch, for change handlers and audit chains."""
    query = df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _await(query, seconds)


def sweep(df: DataFrame, time: str, ttl: str, now: Column | None = None) -> DataFrame:
    """Rows that haven't outlived ``ttl``; the base of a scheduled purge."""
    return df.where(F.col(time) >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {ttl}"))
