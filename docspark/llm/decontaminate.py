"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of the item's distinct
``k``-word shingles occur anywhere in the document's whole text.  An item with
fewer than ``k`` words has one shingle, its whole word sequence.

1. A bitmap of the items' shingles goes to the scan of the documents.  Only
   shingles that occur in some item can count towards containment, so each
   document is reduced to those without changing any containment, and a long
   document becomes about as small as the items it holds.  The bitmap has no
   false negatives and at most ``MAX_BITS`` bits at any number of items.
2. The reduced documents are partitioned by size (powers of two).  For each
   pair of a size class of items and a partition, the containment threshold
   becomes a Jaccard threshold by the partition's upper bound, and MinHash
   bands of as many rows as keep a recall of ``recall`` are chosen.  Where no
   banding can (huge reduced documents, tiny items), single shingles are the
   keys, which is exact.
3. Candidates are verified by exact shingle containment, on the shingles' words.

Result: distinct (doc_id, item_id, containment).  Rows with a null doc_id or
item_id, and null, empty or wordless texts, are in no result.  Rows that repeat
a doc_id report the best of their containments.  Extra columns are ignored.
Either table empty: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sized, written
from .textkernel import U64, byte_batches, byte_view, mix64, shingles, word_hashes

HASHES = 128
MAX_BITS = 1 << 27
EXACT_HASHES = 1 << 20
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=U64))


def _grams(texts: pa.Array, a: int, b: int, lengths: list[int]):
    raw, off = byte_view(texts.slice(a, b - a))
    h, doc, starts, ends = word_hashes(raw, off)
    for w in lengths:
        s, at = shingles(h, doc, w)
        yield w, s ^ U64(w), at, doc, starts, ends, raw


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, w: int) -> str:
    return " ".join(raw[s:e].tobytes().decode("utf8", "replace") for s, e in zip(starts[at : at + w], ends[at : at + w]))


def item_shingles(benchmark: DataFrame, k: int, item: str, text: str) -> DataFrame:
    """(item_id, w, size, hashes, grams) of every item with a word."""

    def run(batch):
        texts = batch.column(1)
        rows: dict[int, tuple[int, dict[str, int]]] = {}
        for a, b in byte_batches(texts):
            _, doc, _, _ = word_hashes(*byte_view(texts.slice(a, b - a)))
            own = np.minimum(np.bincount(doc, minlength=b - a), k)
            for w, s, at, doc, starts, ends, raw in _grams(texts, a, b, list(range(1, k + 1))):
                for x, i in zip(s.view(np.int64).tolist(), at.tolist()):
                    if own[doc[i]] == w:
                        rows.setdefault(a + int(doc[i]), (w, {}))[1][_words(raw, starts, ends, i, w)] = x
        at = sorted(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array([rows[i][0] for i in at], pa.int32()), pa.array([list(rows[i][1].values()) for i in at], pa.list_(pa.int64())), pa.array([list(rows[i][1]) for i in at], pa.list_(pa.string()))],
            names=["item_id", "w", "hashes", "grams"],
        )

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long"), F.col(text))
    return arrow_map(rows, run, "item_id long, w int, hashes array<long>, grams array<string>").withColumn("size", F.size("hashes"))


def shingle_bitmap(items: DataFrame, count: int) -> np.ndarray:
    """One bit per bucket of the items' shingle hashes; each partition sends one bitmap."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (64 * max(1, count) - 1).bit_length()))

    def run(batches):
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[batch.column(0).flatten().to_numpy(zero_copy_only=False).view(U64) % U64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in items.select("hashes").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def banding(threshold: float, q: int, upper: int, recall: float) -> int:
    """Rows per band for items of size q or more and documents of size up to ``upper``; 0 if no banding keeps the recall."""
    j = threshold * q / (upper + q - threshold * q)
    best = 0
    for r in (1, 2, 4, 8, 16):
        if 1 - (1 - j**r) ** (HASHES // r) >= recall:
            best = r
    return best


def _minima(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, HASHES), U64)
    starts = np.searchsorted(owner, np.arange(n))
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(mix64(hashes ^ _SEEDS[j]), starts)
    return out


def _band_keys(minima: np.ndarray, r: int, part: int) -> np.ndarray:
    """Band keys of one (partition, rows-per-band) table: (n, HASHES // r)."""
    key = np.zeros((len(minima), HASHES // r), U64)
    for j in range(r):
        key = mix64(key ^ minima[:, j : r * (HASHES // r) : r])
    return mix64(key ^ (np.arange(HASHES // r, dtype=U64) << U64(16)) ^ U64(part << 8 | r))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, threshold: float = 0.6, recall: float = 0.995, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) of every item found in a document."""
    items = written(item_shingles(benchmark, k, item, item_text), "decontam-items")
    stat = items.agg(F.sum("size"), F.collect_set("w"), F.min("size"), F.collect_set(F.floor(F.log2("size")).cast("int"))).first()
    count, lengths, classes = stat[0] or 0, sorted(stat[1]), sorted(stat[3])
    flags = shingle_bitmap(items, count)
    bits = U64(len(flags))
    members = None
    if count <= EXACT_HASHES:
        members = np.array(sorted(r[0] for r in items.select(F.explode("hashes")).distinct().collect()), np.int64)
    least = math.ceil(threshold * (stat[2] or 1) - 1e-9)
    plan = {p: {c: banding(threshold, 1 << c, (2 << p) - 1, recall) for c in classes if (2 << p) - 1 >= threshold * (1 << c)} for p in range(40)}

    def reduce(batch):
        """The document's shingles that occur in items, its size partition and its keys."""
        texts = batch.column(1)
        for a, b in byte_batches(texts):
            found: dict[int, dict[str, int]] = {}
            for w, s, at, doc, starts, ends, raw in _grams(texts, a, b, lengths):
                hit = np.flatnonzero(flags[s % bits])
                if members is not None:
                    x = s[hit].view(np.int64)
                    hit = hit[members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x]
                for i in hit.tolist():
                    found.setdefault(int(doc[at[i]]), {})[_words(raw, starts, ends, int(at[i]), w)] = int(s[i].view(np.int64))
            at = [i for i in sorted(found) if len(found[i]) >= least]
            if not at:
                continue
            keys = _keys([list(found[i].values()) for i in at], lambda size: [(size.bit_length() - 1, r) for r in sorted(set(plan[size.bit_length() - 1].values()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([a + i for i in at])), pa.array([list(found[i]) for i in at], pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "grams", "keys"]
            )

    def item_keys(batch):
        sets = batch.column(1).to_pylist()
        keys = _keys(sets, lambda size: [(p, plan[p][c]) for p in plan if (c := size.bit_length() - 1) in plan[p]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "keys"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    reduced = written(arrow_map(rows, reduce, "doc_id long, grams array<string>, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    probes = written(arrow_map(items.select("item_id", "hashes"), item_keys, "item_id long, keys array<long>").select("item_id", F.explode(F.array_distinct("keys")).alias("key")), "decontam-probes")
    pairs = reduced.select("row", F.explode(F.array_distinct("keys")).alias("key")).join(sized(probes), "key").select("row", "item_id").distinct()
    sides = items.select("item_id", F.col("grams").alias("item_grams"), "size")
    checked = pairs.join(sized(sides), "item_id").join(reduced.select("row", "doc_id", "grams"), "row")
    inside = F.size(F.array_intersect("grams", "item_grams")) / F.col("size")
    return checked.select("doc_id", "item_id", inside.alias("containment")).where(F.col("containment") >= threshold).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _keys(sets: list[list[int]], tables) -> list[list[int]]:
    """Keys of each set in each of its (partition, rows) tables; rows 0: every shingle is a key."""
    if not sets:
        return []
    hashes = np.array([x for s in sets for x in s], np.int64).view(U64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    minima = _minima(hashes, owner, len(sets))
    out: list[list[int]] = [[] for _ in sets]
    cells: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(sets):
        for cell in tables(len(s)):
            cells.setdefault(cell, []).append(i)
    for (p, r), own in cells.items():
        if r:
            for i, row in zip(own, _band_keys(minima[own], r, p).view(np.int64).tolist()):
                out[i] += row
        else:
            for i in own:
                out[i] += mix64(np.array(sets[i], np.int64).view(U64) ^ U64(p << 8)).view(np.int64).tolist()
    return out
