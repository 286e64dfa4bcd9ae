"""Versions, snapshots, merges and logs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: one partial-aggregating group-by, no window."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return out.select(key, *(F.col(f"_v.`{c}`").alias(c) for c in rest)).select(*df.columns)


def as_of(history: DataFrame, when: Any, *, key: str = "doc_id", ts: str = "commit_ts", deleted: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """Each document's version at a time; documents deleted by then are absent."""
    out = latest(history.where(F.col(ts) <= F.lit(when)), key, [ts, *(tie or [])])
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def lww_merge(*replicas: DataFrame, key: str = "docId", ts: str = "timestamp", node: str = "nodeId", tombstone: str = "isTombstone") -> DataFrame:
    """Last writer wins over all replicas by (time, node); tombstones hide their documents."""
    union = replicas[0]
    for r in replicas[1:]:
        union = union.unionByName(r)
    return latest(union, key, [ts, node]).where(~F.coalesce(F.col(tombstone), F.lit(False)))


def conflicts(writes: DataFrame, *, key: str = "doc_id", start: str = "start_ts", commit: str = "commit_ts", tx: str = "tx_id") -> DataFrame:
    """Transactions that lose by first-committer-wins: another committed the same key in (start, commit)."""
    a, b = writes.alias("a"), writes.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{tx}") != F.col(f"b.{tx}")) & (F.col(f"b.{commit}") > F.col(f"a.{start}")) & ((F.col(f"b.{commit}") < F.col(f"a.{commit}")) | ((F.col(f"b.{commit}") == F.col(f"a.{commit}")) & (F.col(f"b.{tx}") < F.col(f"a.{tx}"))))
    return a.join(b, on, "left_semi")


def vacuum(history: DataFrame, oldest_snapshot: Any, *, key: str = "doc_id", ts: str = "commit_ts") -> DataFrame:
    """Versions that a snapshot of ``oldest_snapshot`` or later can see."""
    visible = F.max(F.when(F.col(ts) <= F.lit(oldest_snapshot), F.col(ts))).over(Window.partitionBy(key))
    return history.withColumn("_visible", visible).where(F.col("_visible").isNull() | (F.col(ts) >= F.col("_visible"))).drop("_visible")


def read_from(log: DataFrame, seq: int, most: int | None = None) -> DataFrame:
    """Log entries after a sequence number, in order."""
    out = log.where(F.col("seq") > seq).orderBy("seq")
    return out.limit(most) if most else out


def resume_token(seq: Column | str = "seq") -> Column:
    return F.sha2(F.concat(F.lit("seq:"), (F.col(seq) if isinstance(seq, str) else seq).cast("string")), 256)


def pending(outbox: DataFrame, acknowledged: DataFrame, most: int = 100, *, key: str = "event_id") -> DataFrame:
    """Outbox events that aren't acknowledged, oldest first."""
    return outbox.join(acknowledged.select(key), key, "left_anti").orderBy(key).limit(most)


def tail(log: DataFrame, most: int = 50, *, ts: str = "ts", key: str = "event_id") -> DataFrame:
    return log.orderBy(F.desc(ts), F.desc(key)).limit(most)


def since(log: DataFrame, when: Any, most: int | None = None, *, ts: str = "ts", key: str = "event_id") -> DataFrame:
    out = log.where(F.col(ts) >= F.lit(when)).orderBy(ts, key)
    return out.limit(most) if most else out


def topic_matches(topic: Column, pattern: Column | str) -> Column:
    """Exact topics, 'prefix:*', '*', and '*' for one dotted segment."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    quoted = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+?^$(){}\[\]|\\])", r"\\$1"), r"\*", "[^.]*"), F.lit("$"))
    return (p == "*") | (topic == p) | (p.endswith(":*") & topic.startswith(F.regexp_replace(p, r"\*$", ""))) | F.regexp_like(topic, quoted)


def deliveries(events: DataFrame, subscriptions: DataFrame, *, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """Each event for each subscription whose pattern its topic matches."""
    exact = subscriptions.where(~F.col(pattern).contains("*"))
    wild = subscriptions.where(F.col(pattern).contains("*"))
    a = events.join(exact, F.col(topic) == F.col(pattern))
    b = events.join(wild, topic_matches(F.col(topic), F.col(pattern)))
    return a.unionByName(b)


def dead_letters(messages: DataFrame, most: int = 3) -> DataFrame:
    return messages.where(F.col("retries") >= most)


def topic_history(events: DataFrame, most: int, *, topic: str = "topic", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest events of each topic."""
    order = Window.partitionBy(topic).orderBy(F.desc(ts), F.desc(key))
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def presence(beats: DataFrame, now: Any, timeout_ms: int = 10_000, *, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, last_seen, online) at a time."""
    out = beats.where(F.col(ts) <= F.lit(now)).groupBy(user).agg(F.max(ts).alias("last_seen"))
    gap = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("last_seen").cast("timestamp"))
    return out.withColumn("online", gap <= timeout_ms)
