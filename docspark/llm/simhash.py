"""Operator 6: near-duplicate groups by SimHash and the generalised pigeonhole principle.

A text's SimHash has 64 bits over its distinct words (lower-cased).  Texts are
near duplicates if their SimHashes differ in at most ``tau`` bits and the
resemblance of their word pairs, estimated from 32 one-byte minima kept beside
each SimHash, is at least ``resemblance``.  Groups are the connected components.

The search for pairs:

1. Equal (SimHash, minima) are collapsed first, so exact copies cost one row.
2. Bits are grouped into ``parts`` partitions, correlated bits together, from
   the bit covariance over all signatures.
3. For each partition the number of pairs at each distance is exact: a
   Walsh-Hadamard autocorrelation of the histogram of the partition's values.
   Dynamic programming chooses thresholds t_i >= -1 with sum tau - parts + 1
   that give the fewest candidates.  Any pair within tau bits is within t_i in
   some partition, so the search misses none.
4. Every signature is a query.  Of two plans for the same pairs the one that
   moves fewer rows is taken.  Tiles: signatures are cut into tiles by hash; every
   pair of tiles is one task which probes each partition's index with all values
   within t_i and verifies.  Keys: each signature goes to all values within
   ceil(t_i / 2) of its own in each partition, and is near those within
   floor(t_i / 2); two values within t_i share such a key, near for one of them,
   so each key is one task which verifies its pairs.  The number of rows a
   signature is moved as is then fixed by the thresholds, not by the number of
   signatures; keys with more than ``tile_rows`` rows are cut in pairs of cells.
   Tasks reduce what they found to a spanning star per local component, so
   thousands of copies don't become millions of pairs.
5. Components of the stars by iterated minimum propagation with checkpoints.

Rows with a null key, and null, empty or wordless texts, are in no group.
Rows that repeat a key count as one document if they have equal signatures.
Equal texts always share a group; the smallest key of a group is its ``group_id``.
Extra columns are ignored.  An empty table gives no groups.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, written
from .textkernel import U64, byte_batches, byte_view, mix64, shingles, word_hashes

MINIMA = 32
TEXT_BITS = 20


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash, minima (n, 32) and number of words of each text."""
    n = len(texts)
    sig, mins, count = np.zeros(n, U64), np.zeros((n, MINIMA), np.uint8), np.zeros(n, np.int64)
    for a, b in byte_batches(texts):
        m = b - a
        h, doc, _, _ = word_hashes(*byte_view(texts.slice(a, m)))
        if not len(h):
            continue
        count[a:b] = np.bincount(doc, minlength=m)
        bits = U64(TEXT_BITS)  # the same for all slices: features are the hashes' other bits
        keys = np.unique((doc.astype(U64) << (U64(64) - bits)) | (h >> bits))
        of = (keys >> (U64(64) - bits)).astype(np.int64)
        feature = mix64(keys << bits)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        present, size = of[starts], np.diff(np.r_[starts, len(of)])
        own = np.zeros(len(starts), U64)
        for j in range(64):
            ones = np.add.reduceat(((feature >> U64(j)) & U64(1)).astype(np.int32), starts)
            own |= (2 * ones > size).astype(U64) << U64(j)
        sig[a + present] = own
        pair, at = shingles(h, doc, 2)
        pair, of = np.r_[pair, h[count[a:b][doc] == 1]], np.r_[doc[at], doc[count[a:b][doc] == 1]]
        order = np.argsort(of, kind="stable")
        pair, of = pair[order], of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for j in range(MINIMA):
            low = np.minimum.reduceat((pair ^ U64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) * U64(2 * j * 0x5851F42D4C957F2D % (1 << 64) | 1), starts)
            mins[a + of[starts], j] = (mix64(low) >> U64(56)).astype(np.uint8)
    return sig, mins, count


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sig, mins) of the documents that have a key and a word."""

    def run(batch):
        sig, mins, count = signatures_of(batch.column(1))
        out = [batch.column(0), pa.array(sig.view(np.int64)), pa.array([m.tobytes() for m in mins], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["id", "sig", "mins"]).filter(pa.array(count > 0))

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    return arrow_map(rows, run, "id long, sig long, mins binary")


def bit_statistics(reps: DataFrame) -> tuple[np.ndarray, int]:
    """Covariance of the 64 bits over all signatures."""

    def run(batches):
        total, both, n = np.zeros(64), np.zeros((64, 64)), 0
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.sum(axis=0)
            both += x.T @ x
            n += len(x)
        values = np.r_[n, total, both.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    got = reps.select("sig").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at").value.to_numpy()
    if not len(got) or not got[0]:
        return np.eye(64), 0
    n, mean, both = got[0], got[1:65] / got[0], got[65:].reshape(64, 64) / got[0]
    return both - np.outer(mean, mean), int(n)


def group_bits(covariance: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` equal partitions; each starts with the freest bit and takes its most correlated ones."""
    scale = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
    corr = np.abs(covariance / np.outer(scale, scale))
    left, out = list(range(64)), []
    for p in range(parts):
        width = -(-len(left) // (parts - p))
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def part_values(sig: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(sig), np.int64)
    for j, b in enumerate(bits):
        out |= ((sig >> U64(b)) & U64(1)).astype(np.int64) << j
    return out


def pairs_by_distance(histogram: np.ndarray) -> np.ndarray:
    """Ordered pairs of rows at each Hamming distance of their values, exact, by Walsh-Hadamard."""
    x = histogram.astype(float)
    for _ in range(2):
        h = 1
        while h < len(x):
            x = x.reshape(-1, 2, h)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
            h *= 2
        x = x * x if _ == 0 else x / len(x)
    return np.bincount(np.bitwise_count(np.arange(len(x))), weights=np.round(x), minlength=int(len(x)).bit_length())


def allocate(costs: list[np.ndarray], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum tau - m + 1 of the least total cost; costs[i][t] is cumulative."""
    m, goal = len(costs), tau - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (s, (cost, ts)), t in itertools.product(best.items(), range(-1, min(len(c) - 1, tau) + 1)):
            new = cost + (c[t] if t >= 0 else 0.0)
            if s + t not in step or new < step[s + t][0]:
                step[s + t] = (new, [*ts, t])
        best = step
    return best[goal][1]


def plan(reps: DataFrame, tau: int, parts: int, tile_rows: int) -> tuple[list[list[int]], list[int], int]:
    """Partitions of the bits, thresholds, number of signatures."""
    covariance, n = bit_statistics(reps)
    groups = group_bits(covariance, parts)

    def run(batches):
        hists = [np.zeros(1 << len(g), np.int64) for g in groups]
        for batch in batches:
            sig = batch.column(0).to_numpy().view(U64)
            for h, g in zip(hists, groups):
                h += np.bincount(part_values(sig, g), minlength=len(h))
        for p, h in enumerate(hists):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), pa.array(at), pa.array(h[at])], names=["part", "value", "n"])

    hist = reps.select("sig").mapInArrow(run, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    costs = []
    for p, g in enumerate(groups):
        h = np.zeros(1 << len(g))
        own = hist[hist.part == p]
        h[own.value.to_numpy()] = own.n.to_numpy()
        spread = pairs_by_distance(h)
        probes = np.cumsum([math.comb(len(g), d) for d in range(len(spread))])
        costs.append(np.cumsum(spread) + 4.0 * n * max(1, n / tile_rows) * probes)  # candidates to verify, probes of every tile
    return groups, allocate(costs, tau), n


def _local_stars(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = root.copy()
        np.minimum.at(new, high, low)
        new = new[new]
        while (again := new[new]).tobytes() != new.tobytes():
            new = again
        if (new == root).all():
            return root
        root = new


def tile_pairs(sig_a, mins_a, sig_b, mins_b, groups, thresholds, tau: int, agree: int, chunk: int = 1 << 21):
    """Pairs (i, j) within tau bits whose minima agree in ``agree`` places."""
    found = []
    for bits, t in zip(groups, thresholds):
        if t < 0:
            continue
        va, vb = part_values(sig_a, bits), part_values(sig_b, bits)
        order = np.argsort(vb, kind="stable")
        first = np.zeros((1 << len(bits)) + 1, np.int64)
        np.cumsum(np.bincount(vb, minlength=1 << len(bits)), out=first[1:])
        for d in range(t + 1):
            for flipped in itertools.combinations(range(len(bits)), d):
                probe = va ^ sum(1 << f for f in flipped)
                lo = first[probe]
                n = first[probe + 1] - lo
                some = np.flatnonzero(n)
                ends = np.cumsum(n[some])
                at = 0
                while at < len(some):
                    base = ends[at - 1] if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, base + chunk, "right")))
                    rows = some[at:to]
                    reps = n[rows]
                    i = np.repeat(rows, reps)
                    j = order[np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo[rows], reps)]
                    near = np.bitwise_count(sig_a[i] ^ sig_b[j]) <= tau
                    i, j = i[near], j[near]
                    if len(i):
                        same = (mins_a[i] == mins_b[j]).sum(axis=1) >= agree
                        found.append(np.stack([i[same], j[same]]))
                    at = to
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _edges(reps: DataFrame, groups, thresholds, tau: int, agree: int, tiles: int) -> DataFrame:
    """(src, dst) stars, src < dst, of the pairs found in every pair of tiles."""
    tile = F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int")
    rows = reps.select("rep", "sig", "mins", tile.alias("tile"))
    of = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.least(F.col("tile"), o) * tiles + F.greatest(F.col("tile"), o))
    spread = rows.withColumn("task", F.explode(of)) if tiles > 1 else rows.withColumn("task", F.lit(0))

    def run(key, table):
        a, b = divmod(key[0].as_py(), tiles)
        ids = table["rep"].to_numpy()
        sig = table["sig"].to_numpy().view(U64)
        mins = np.frombuffer(b"".join(table["mins"].to_pylist()), np.uint8).reshape(-1, MINIMA)
        t = table["tile"].to_numpy()
        order = np.argsort(ids)
        ids, sig, mins, t = ids[order], sig[order], mins[order], t[order]
        left, right = np.flatnonzero(t == a), np.flatnonzero(t == b)
        i, j = tile_pairs(sig[left], mins[left], sig[right], mins[right], groups, thresholds, tau, agree)
        i, j = left[i], right[j]
        root = _local_stars(i, j, len(ids))
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"src": ids[root[at]], "dst": ids[at]})

    return spread.repartition(max(1, tiles * (tiles + 1) // 2), "task").groupBy("task").applyInArrow(run, "src long, dst long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits, by number of bits."""
    return np.array([sum(1 << f for f in flipped) for d in range(radius + 1) for flipped in itertools.combinations(range(bits), d)], np.int64)


def rows_by_key(groups, thresholds) -> int:
    """Rows a signature is moved as by ``_keyed_edges``."""
    return sum(len(ball(len(g), -(-t // 2))) for g, t in zip(groups, thresholds) if t >= 0)


def near_pairs(sig: np.ndarray, mins: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, tau: int, agree: int, chunk: int = 1 << 21):
    """Pairs (i, j), i from ``left`` and j from ``right``, one of them near, within tau bits whose minima agree in ``agree`` places."""
    found = [np.zeros((2, 0), np.int64)]
    for a, b in ((left[near[left]], right), (left[~near[left]], right[near[right]])):
        step = max(1, chunk // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            own = a[at : at + step]
            i, j = np.nonzero(np.bitwise_count(sig[own][:, None] ^ sig[b][None, :]) <= tau)
            i, j = own[i], b[j]
            same = (i != j) & ((mins[i] == mins[j]).sum(axis=1) >= agree)
            found.append(np.stack([i[same], j[same]]))
    return np.concatenate(found, axis=1)


def _keyed_edges(reps: DataFrame, groups, thresholds, tau: int, agree: int, cell_rows: int) -> DataFrame:
    """(src, dst) stars, src < dst, of the pairs found under every key of every partition."""
    parts = [(p, g, ball(len(g), -(-t // 2)), len(ball(len(g), t // 2))) for p, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def spread(batch):
        sig = batch.column(1).to_numpy().view(U64)
        for p, bits, masks, n_near in parts:
            step = max(1, (1 << 18) // len(masks))
            for a in range(0, len(sig), step):
                keys = part_values(sig[a : a + step], bits)[:, None] ^ masks[None, :]
                rows = np.repeat(np.arange(a, a + len(keys)), len(masks))
                near = np.tile(np.arange(len(masks)) < n_near, len(keys))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(((p << 32) | keys.ravel())), pa.array(near)], names=["rep", "sig", "mins", "key", "near"])

    spread_rows = arrow_map(reps.select("rep", "sig", "mins"), spread, "rep long, sig long, mins binary, key long, near boolean")
    counts = written(spread_rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "simhash-keys")  # a row a value of a partition at most
    cells = F.ceil(F.col("_n") / cell_rows).cast("int")
    rows = spread_rows.join(F.broadcast(counts.where("_n > 1").select(F.col("key").alias("_key"), cells.alias("cells"))), F.col("key") == F.col("_key")).drop("_key")
    own = F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.least(own, o) * F.col("cells") + F.greatest(own, o))
    rows = rows.withColumn("cell", own).withColumn("pair", F.explode(pair))

    def run(key, table):
        first, second = divmod(key[1].as_py(), key[2].as_py())
        ids, sig, near, cell = table["rep"].to_numpy(), table["sig"].to_numpy().view(U64), table["near"].to_numpy(zero_copy_only=False), table["cell"].to_numpy()
        mins = np.frombuffer(b"".join(table["mins"].to_pylist()), np.uint8).reshape(-1, MINIMA)
        order = np.argsort(ids)
        ids, sig, mins, near, cell = ids[order], sig[order], mins[order], near[order], cell[order]
        i, j = near_pairs(sig, mins, near, np.flatnonzero(cell == first), np.flatnonzero(cell == second), tau, agree)
        root = _local_stars(i, j, len(ids))
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"src": ids[root[at]], "dst": ids[at]})

    return rows.groupBy("key", "pair", "cells").applyInArrow(run, "src long, dst long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): each node of the edges and the smallest node of its component (large-star, small-star)."""
    edges = checkpointed(edges.distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("low", "src").alias("low"))
        large = both.join(low, "src").where(F.col("dst") > F.col("src")).select(F.col("low").alias("src"), "dst")
        large = large.where("src <> dst").distinct()
        down = large.groupBy("dst").agg(F.min("src").alias("low"))
        small = large.join(down, "dst")
        new = small.select(F.col("low").alias("src"), "dst").unionByName(small.where("src <> low").select(F.col("low").alias("src"), F.col("src").alias("dst"))).distinct()
        new = checkpointed(new)
        mark = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if mark(new) == mark(edges):
            return new.select(F.col("dst").alias("node"), F.col("src").alias("root"))
        edges = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tau: int = 10, resemblance: float = 0.35, parts: int = 4, tile_rows: int = 120_000, by_key: bool | None = None) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near duplicate; one document of a group has ``keep``.  ``by_key`` forces a plan."""
    signed = written(sign(docs, key, text), "simhash")
    reps = written(signed.groupBy("sig", "mins").agg(F.min("id").alias("rep")), "simhash-reps")
    groups, thresholds, n = plan(reps, tau, parts, tile_rows)
    members = signed.join(reps, ["sig", "mins"]).select("id", "rep").distinct()
    if not n:
        return members.select(F.col("id").alias("doc_id"), F.col("rep").alias("group_id"), F.lit(True).alias("keep")).limit(0)
    tiles = max(1, -(-n // tile_rows))
    agree = int(np.ceil((resemblance + (1 - resemblance) / 256) * MINIMA))
    same = members.where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    if by_key if by_key is not None else rows_by_key(groups, thresholds) < tiles:
        edges = _keyed_edges(reps, groups, thresholds, tau, agree, tile_rows)
    else:
        edges = _edges(reps, groups, thresholds, tau, agree, tiles)
    found = components(edges.unionByName(same))
    found = found.groupBy("node").agg(F.min("root").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))
