"""Operator 1: passages of at least ``length`` words that repeat across documents, by suffix arrays.

Every window of ``length`` words has one minimiser, the least hash of its
``anchor``-word shingles, and the windows of a document with the same minimiser
are a run.  Equal windows have equal minimisers wherever they are, so only runs
with an equal key need to be compared, and a key seen in one document only is
done with.  This is exact: no window is left out and nothing is capped.

* Runs of one or two windows are compared as windows, by equality, so a hot
  passage costs one narrow row an occurrence.  They are also compared with the
  windows of longer runs that have their minimiser.
* Longer runs are contexts (the words they span).  A context that occurs in two
  documents is repeated as a whole.  Distinct contexts of one key go, once
  each, to a shard where their common parts are found: the shard's suffix array
  is built by induced sorting (suffixes classified, leftmost-smaller substrings
  sorted and named recursively, the rest induced in linear time), common
  prefixes are computed in text order (permuted LCP), and suffixes between
  which the LCP stays at ``length`` or more share a window.
* A hot key, whose distinct contexts hold more than ``shard_words`` words (a
  license header in as many pages), would be one task however many contexts it
  has.  Its contexts are compared window by window instead, a narrow row each
  that combines before it moves; so a shard is bounded and still nothing is left
  out.

Words are 64-bit hashes of their lower-cased bytes, so punctuation, case and
spacing don't matter.  Windows and contexts are equal if two 64-bit hashes are,
that of the minimiser and their own.

Result: (doc_id, start_word, end_word, n_words), maximal spans of words covered
by windows that occur in another document too.  Rows with a null doc_id, and
null, empty or short texts, have none.  Rows that repeat a doc_id are the same
document.  Repeats within one document alone aren't reported.  Extra columns
are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_map, sized, written
from .textkernel import _BASE, U64, byte_batches, byte_view, mix64, word_hashes

SHORT_RUN = 2
#: Contexts up to which the lists of them are broadcast to the documents; more are shuffled.
BROADCAST_CONTEXTS = 50_000
SHARD_WORDS = 250_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    m, span = x, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - span : width - span + n]) if span < width else m[:n]


def _poly(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), U64)
    for j in range(k if len(out) else 0):
        out = out * _BASE + h[j : j + len(out)]
    return mix64(out)


def runs(h: np.ndarray, doc: np.ndarray, length: int, anchor: int):
    """Runs of windows with one minimiser: (doc, first window, windows, minimiser, hash); short runs are one window each with its hash."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none.view(U64), none.view(U64)
    grams, window = _poly(h, anchor), _poly(h, length)
    bits = U64(int(len(grams)).bit_length())
    value = (mix64(grams) >> bits << bits) | np.arange(len(grams), dtype=U64)
    least = sliding_minimum(value, length - anchor + 1)
    valid = np.flatnonzero(doc[: len(h) - length + 1] == doc[length - 1 :])
    if not len(valid):
        return none, none, none, none.view(U64), none.view(U64)
    at = (least[valid] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    start, long = valid[first], n > SHORT_RUN
    single = np.concatenate([start[~long], *(start[(n > j) & ~long] + j for j in range(1, SHORT_RUN))])
    s, m = start[long], n[long]
    starts = np.r_[single, s]
    keys = grams[np.r_[(least[single] & ((U64(1) << bits) - U64(1))).astype(np.int64), at[first[long]]]]
    return doc[starts], starts, np.r_[np.ones(len(single), np.int64), m], keys, np.r_[window[single], context_hash(window[s], window[s + m - 1], m)]


def context_hash(first: np.ndarray, last: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hash of a context, from those of its first and last windows and their number (0 for none of them)."""
    return mix64(first * U64(3) ^ mix64(last + windows.astype(U64)))


def _induce(s: list[int], smaller: list[bool], lms: list[int], heads: list[int], tails: list[int]) -> list[int]:
    """Suffixes in order of what the order of the leftmost-smaller ones induces."""
    sa = [-1] * len(s)
    tail = tails.copy()
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = heads.copy()
    for j in sa:
        if j > 0 and not smaller[j - 1]:
            c = s[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = tails.copy()
    for j in reversed(sa):
        if j > 0 and smaller[j - 1]:
            c = s[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting; the last symbol is 0 and occurs nowhere else, symbols are dense."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(text))
    settled = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(settled[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.where(following < n, step[np.minimum(following, n - 2)] > 0, False)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    tails = tails.tolist()
    s, kinds = text.tolist(), smaller.tolist()
    order = np.array(_induce(s, kinds, lms.tolist(), heads, tails), np.int64)
    # Name the leftmost-smaller substrings in their sorted order.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    end = np.empty(n, np.int64)
    end[lms] = np.r_[lms[1:], n - 1]
    size = end[ranked] - ranked + 1
    same = np.zeros(len(ranked), bool)
    equal = np.flatnonzero((size[1:] == size[:-1]) & (text[ranked[1:]] == text[ranked[:-1]])) + 1
    for i in equal.tolist():
        a, b, w = ranked[i - 1], ranked[i], size[i]
        same[i] = w <= n - max(a, b) and bool((text[a : a + w] == text[b : b + w]).all()) and bool((smaller[a : a + w] == smaller[b : b + w]).all())
    names = np.empty(n, np.int64)
    names[ranked] = np.cumsum(~same) - 1
    reduced = names[lms]
    if same.any():
        sorted_lms = lms[suffix_array(reduced)]
    else:
        sorted_lms = ranked
    return np.array(_induce(s, kinds, sorted_lms.tolist(), heads, tails), np.int64)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each suffix, in text order, with its predecessor in suffix order."""
    before = np.empty(len(sa), np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    s, phi = text.tolist(), before.tolist()
    out, same = [0] * len(s), 0
    for i, j in enumerate(phi):
        if j < 0:
            same = 0
            continue
        while s[i + same] == s[j + same]:
            same += 1
        out[i] = same
        if same:
            same -= 1
    return np.array(out, np.int64)


def repeated_windows(contexts: list[np.ndarray], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Flags of the windows (positions of the concatenated contexts) that occur in two documents.

    low, high: smallest and largest document of each context.
    """
    words, ids = np.unique(np.concatenate(contexts), return_inverse=True)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(ends[-1] + 1, np.int64)
    of = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    text[:-1][inside] = ids + 1
    text[ends - 1] = len(words) + 1 + np.arange(len(contexts))  # every separator is a symbol of its own
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)[sa]
    group = np.cumsum(lcp < length)
    at = np.minimum(sa, len(of) - 1)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least, most = np.minimum.reduceat(low[of[at]], first), np.maximum.reduceat(high[of[at]], first)
    flags = np.zeros(len(text), bool)
    flags[sa] = (least < most)[group - group[0]] & (np.diff(np.r_[first, len(sa)]) > 1)[group - group[0]]
    return flags[:-1]


def _scan(docs: DataFrame, key: str, text: str, length: int, anchor: int) -> DataFrame:
    def run(batch):
        for a, b in byte_batches(batch.column(1)):
            h, doc, _, _ = word_hashes(*byte_view(batch.column(1).slice(a, b - a)))
            own, start, n, keys, context = runs(h, doc, length, anchor)
            if len(own):
                base = np.searchsorted(doc, np.arange(b - a))
                out = [batch.column(0).take(pa.array(a + own)), pa.array((start - base[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(context.view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n", "key", "hash"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    return arrow_map(rows, run, "doc_id long, start int, n int, key long, hash long")


def _context_words(docs: DataFrame, wanted: DataFrame, key: str, text: str, length: int, anchor: int) -> DataFrame:
    """(key, context, low, high, words) of the wanted contexts (key, context, low, high, start, n; low is the document to read)."""
    lists = written(wanted.groupBy(F.col("low").alias("_doc")).agg(F.collect_list(F.struct("start", "n", "key", "context", "high")).alias("wanted")), "repeats-wanted")
    small = wanted.limit(BROADCAST_CONTEXTS + 1).count() <= BROADCAST_CONTEXTS
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    if not small:  # only the texts of documents with a wanted context move
        texts = texts.join(sized(lists.select(F.col("_doc").alias("_id")), BROADCAST_IDS), "_id", "left_semi")
    rows = texts.join(F.broadcast(lists) if small else lists, F.col("_id") == F.col("_doc")).select("_doc", "_text", "wanted")

    def run(batch):
        texts, lists = batch.column(1), batch.column(2)
        for a, b in byte_batches(texts):
            h, doc, _, _ = word_hashes(*byte_view(texts.slice(a, b - a)))
            base = np.searchsorted(doc, np.arange(b - a + 1))
            out = []
            for i in range(b - a):
                low, own = batch.column(0)[a + i].as_py(), h[base[i] : base[i + 1]]
                for w in lists[a + i].as_py():
                    words = own[w["start"] : w["start"] + w["n"] + length - 1]
                    if len(words) == w["n"] + length - 1:
                        hashed = context_hash(_poly(words[:length], length), _poly(words[-length:], length), np.array([w["n"]]))
                        if hashed.view(np.int64)[0] == w["context"]:  # else another text of the same doc_id
                            out.append((w["key"], w["context"], low, w["high"], words.view(np.int64)))
            if out:
                k, c, lo, hi, words = zip(*out)
                flat = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in words])].astype(np.int32), pa.array(np.concatenate(words)))
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), flat], names=["key", "context", "low", "high", "words"])

    return arrow_map(rows, run, "key long, context long, low long, high long, words array<long>")


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 50, anchor: int = 25, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words), one row for each maximal repeated span."""
    scanned = written(_scan(docs, key, text, length, anchor), "repeats-runs")
    is_long = F.col("n") > 1
    sides = [F.min(F.when(is_long, F.col("doc_id"))).alias("a"), F.max(F.when(is_long, F.col("doc_id"))).alias("b"), F.min(F.when(~is_long, F.col("doc_id"))).alias("c"), F.max(F.when(~is_long, F.col("doc_id"))).alias("d")]
    mixed = F.col("c").isNotNull() & (F.least("a", "c") != F.greatest("b", "d"))
    keys = scanned.groupBy("key").agg(*sides).where((F.col("a") != F.col("b")) | (F.col("a").isNotNull() & mixed)).select("key", F.coalesce(mixed, F.lit(False)).alias("mixed"))
    keys = written(keys, "repeats-keys")
    seen = scanned.where(~is_long).groupBy("key", "hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key", "hash")
    singles = scanned.where(~is_long).join(seen, ["key", "hash"]).select("doc_id", "start", (F.col("start") + length).alias("end"))
    common = written(scanned.where(is_long).join(keys, "key").withColumnRenamed("hash", "context"), "repeats-common")
    contexts = common.groupBy("key", "context", "mixed").agg(F.min(F.struct("doc_id", "start")).alias("_first"), F.max("doc_id").alias("high"), F.first("n").alias("n"))
    contexts = written(contexts.select("key", "context", "mixed", F.col("_first.doc_id").alias("low"), F.col("_first.start").alias("start"), "high", "n"), "repeats-contexts")
    held = F.col("n") + length - 1
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("_k"), F.max("mixed").alias("_m"), F.sum(held).alias("_w")).where("_k > 1 OR _m")
    wanted = written(contexts.join(several.select("key", (F.col("_w") > shard_words).alias("hot")), "key"), "repeats-compared")
    hot = written(wanted.where("hot").select("key").distinct(), "repeats-hot")
    total = wanted.where("NOT hot").agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))

    def shard(group, table):
        lists = table["words"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy().view(U64), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        flags = repeated_windows(parts, table["low"].to_numpy(), table["high"].to_numpy(), length)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        at = np.flatnonzero(flags)
        own = np.searchsorted(begin, at, "right") - 1
        rel = at - begin[own]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (rel[1:] != rel[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1 if len(first) else first
        index = pa.array(own[first])
        return pa.table({"key": table["key"].take(index), "context": table["context"].take(index), "from": pa.array(rel[first].astype(np.int32)), "to": pa.array((rel[last] + length).astype(np.int32))})

    words = written(_context_words(docs, wanted, key, text, length, anchor), "repeats-words")
    sharded = words.join(sized(hot), "key", "left_anti").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    parts = sharded.repartition(int(shards), "shard").groupBy("shard").applyInArrow(shard, "key long, context long, `from` int, `to` int")
    whole = contexts.where("low <> high").select("key", "context", F.lit(0).alias("from"), held.cast("int").alias("to"))
    # Windows of hot keys against each other, and windows of short runs against those of long runs with their minimiser.
    mixed_keys = keys.where("mixed").select("key")
    few = scanned.where(~is_long).join(mixed_keys, "key").select("key", F.col("hash").alias("window"), "doc_id", "start")
    inside = written(_windows(words.join(mixed_keys.union(hot).distinct(), "key"), length), "repeats-windows")
    ends = few.groupBy("key", "window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    held_by = inside.groupBy("key", "window").agg(F.min("low").alias("c"), F.max("high").alias("d"))
    both = written(held_by.join(ends, ["key", "window"]).where(F.least("a", "c") != F.greatest("b", "d")).select("key", "window"), "repeats-mixed")
    among = held_by.where("c <> d").join(sized(hot), "key", "left_semi").select("key", "window")
    reverse = inside.join(both.union(among).distinct(), ["key", "window"]).select("key", "context", F.col("at").alias("from"), (F.col("at") + length).cast("int").alias("to"))
    alone = few.join(both, ["key", "window"]).select("doc_id", "start", (F.col("start") + length).alias("end"))
    found = written(whole.unionByName(parts).unionByName(reverse), "repeats-found")
    spans = common.join(found, ["key", "context"]).select("doc_id", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    return merge_spans(spans.unionByName(singles).unionByName(alone))


def _windows(words: DataFrame, length: int) -> DataFrame:
    """(key, context, low, high, at, window): every window of the contexts."""

    def run(batch):
        lists = batch.column(4)
        for i in range(batch.num_rows):
            hashes = _poly(lists[i].values.to_numpy().view(U64), length)
            n = len(hashes)
            yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(j)[i], n) for j in range(4)), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes.view(np.int64))], names=["key", "context", "low", "high", "at", "window"])

    return arrow_map(words.select("key", "context", "low", "high", "words"), run, "key long, context long, low long, high long, `at` int, window long")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans of each document with overlapping and touching ones joined."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = spans.distinct().withColumn("_reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_island", F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "_island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("_island")
    return out.withColumn("n_words", F.col("end_word") - F.col("start_word"))
