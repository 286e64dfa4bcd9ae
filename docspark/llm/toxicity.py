"""Operator 5: toxicity by non-negative positive-unlabelled learning.

The confirmed toxic documents are the positives; all other text is unlabelled.
A linear model is trained by the non-negative risk estimator

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),

with the class prior from the labels and logistic loss: whenever the corrected
negative risk is below zero, the step ascends it instead, so the model can't
overfit the positives.

Features are the distinct words of a text and their leading bytes (3 to 6),
as 64-bit hashes: toxic coinages often share a stem.  Those in at least
``min_df`` positives are candidates; their frequency is counted over all
documents, and the model has those that are ``significance`` standard
deviations more, or less, frequent among positives than by chance.  All these
counts are of distinct texts: each of n copies counts 1 / n.

The positive risk is taken over at most ``max_positives`` labelled texts, the
first by a seeded hash.  Unlabelled risk, counts and scores cover all documents:
every distinct text is a row of its features, rows are dealt by hash into blocks
of about ``block_rows``, each task steps from the common weights over its block,
and the weights are averaged (iterative parameter mixing), ``rounds`` times.
A feature of the model that no training positive has gets its weight from the
counts: alone in a text, it makes the score the log odds of its texts' share
that is toxic.

The prior is the share of the labels that are toxic or, if all are, which tells
nothing, the share of the distinct texts that are positives.

Null, empty and wordless texts are never toxic.  Repeated rows get the same
score, and copies of a text count once in training.  Null keys are scored but
can't be positives.  Null labels count as unlabelled; a key with several labels
is a positive if one says so.  Without positives nothing is reported.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_map, sized, written
from .textkernel import U64, byte_batches, byte_view, mix64, span_hashes, sums_by, words

PREFIXES = (3, 4, 5, 6)


def features(texts: pa.Array):
    """Slices of the array with the (feature, text) pairs of each: (first, last, hashes, index of the text in the slice)."""
    for a, b in byte_batches(texts):
        raw, off = byte_view(texts.slice(a, b - a))
        starts, ends, doc = words(raw, off)
        hashes, owners = [span_hashes(raw, starts, ends)], [doc]
        for n in PREFIXES:
            long = ends - starts > n
            hashes.append(mix64(span_hashes(raw, starts[long], starts[long] + n) ^ U64(n)))
            owners.append(doc[long])
        yield a, b, np.concatenate(hashes), np.concatenate(owners)


def _presence(hashes: np.ndarray, doc: np.ndarray, known: np.ndarray):
    """Distinct (text, index in the sorted array ``known``) pairs, in order of the text."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    pair = np.unique(doc[hit] * len(known) + at[hit])
    return pair // len(known), pair % len(known)


def _sample(docs: DataFrame, text: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct texts, the first by a seeded hash: (text).

    Only hashes below a threshold are sorted, and only the texts of those taken move.
    """
    hashed = docs.where(F.length(text) > 0).select(F.col(text).alias("text"), F.xxhash64(F.lit(seed), text).alias("_h"))
    n = hashed.count()
    share = min(1.0, 4 * most / max(1, n))  # as copies are one text, some to spare
    low = hashed.where(F.col("_h") < int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    taken = low.select("_h").distinct().orderBy("_h").limit(most)
    return low.join(F.broadcast(taken), "_h", "left_semi").groupBy("_h").agg(F.min("text").alias("text")).select("text")


def _weighted(docs: DataFrame, text: str) -> DataFrame:
    """(text, weight) of the rows with a text: 1 / copies, so that weights add up to distinct texts.  Only hashes are grouped."""
    hashed = docs.where(F.length(text) > 0).select(F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    copies = sized(written(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "toxic-copies"), BROADCAST_IDS)
    return hashed.join(copies, "_h", "left").select("text", (F.lit(1.0) / F.coalesce("_n", F.lit(1))).alias("weight"))


def candidate_features(positives: DataFrame, min_df: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the features of at least ``min_df`` distinct positives, the counts of these, and the number of positives; rows are (text, weight)."""

    def run(batch):
        weight = batch.column(1).to_numpy()
        for a, b, h, doc in features(batch.column(0)):
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
            own, at = np.unique(h[first], return_inverse=True)
            n = np.bincount(at, weights=weight[a:b][doc[first]], minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["feature", "n"])

    n_p = positives.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    found = arrow_map(positives, run, "feature long, n double").groupBy("feature").agg(F.round(F.sum("n")).cast("long").alias("n")).where(F.col("n") >= min_df).toPandas()
    known = found.feature.to_numpy(np.int64).view(U64)
    order = np.argsort(known)
    return known[order], found.n.to_numpy(np.int64)[order], round(n_p)


def document_frequency(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct texts with each known feature, and distinct texts with a word, over all rows of (text, weight)."""

    def run(batches):
        total, n = np.zeros(len(known)), 0.0
        for batch in batches:
            weight = batch.column(1).to_numpy()
            for a, b, h, doc in features(batch.column(0)):
                own, at = _presence(h, doc, known)
                total += np.bincount(at, weights=weight[a:b][own], minlength=len(known))
                n += weight[a:b][np.unique(doc)].sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["at", "n"])

    got = docs.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(known) + 1, np.int64)
    out[got["at"].to_numpy() + 1] = np.rint(got["n"].to_numpy())
    return out[1:], int(out[0])


def _rows_of(sample: DataFrame, known: np.ndarray) -> list[np.ndarray]:
    return [np.array(r, np.int64) for r in sorted(list(row["at"]) for row in feature_rows(sample, known).select("at").collect())]


def feature_rows(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(h, at): the known features of each distinct text with a word, with a hash of it."""

    def run(batch):
        for a, b, h, doc in features(batch.column(0)):
            own, at = _presence(h, doc, known)
            sizes = np.bincount(own, minlength=b - a)
            rows = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), rows], names=["h", "at"]).filter(pa.array(np.bincount(doc, minlength=b - a) > 0))

    rows = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    return arrow_map(rows, run, "h long, at array<int>").groupBy("h").agg(F.first("at").alias("at"))


def fit(positive: list[np.ndarray], rows: DataFrame, size: int, prior: float, *, rounds: int, block_rows: int, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias, from the positives and all unlabelled rows (h, at) in blocks, by iterative parameter mixing."""
    blocks = max(1, round(rows.count() / block_rows))
    dealt = written(rows.repartition(blocks, "h").sortWithinPartitions("h"), "toxic-blocks") if blocks > 1 else rows
    weights, bias = np.zeros(size), -1.0
    for _ in range(rounds):
        start, first = weights, bias

        def run(batches):
            total, n, held = np.zeros(size + 1), 0, []

            def step():
                w, c = nnpu(positive, held, size, prior, steps=steps, decay=decay, start=start, bias=first)
                return np.r_[w, c] * len(held)

            for batch in batches:
                for row in batch.column(0):
                    held.append(row.values.to_numpy(zero_copy_only=False))
                    if len(held) >= 2 * block_rows:
                        total, n, held = total + step(), n + len(held), []
            if held:
                total, n = total + step(), n + len(held)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size + 1)), pa.array(np.r_[n, total])], names=["at", "value"])

        got = dealt.select("at").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at").value.to_numpy()
        if not len(got):
            break
        weights, bias = got[1:-1] / got[0], got[-1] / got[0]
    return weights, bias


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, *, steps: int = 300, rate: float = 0.05, beta: float = 0.0, gamma: float = 1.0, decay: float = 1e-3, start: np.ndarray | None = None, bias: float = -1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model; rows are arrays of present features."""

    def flat(rows):
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (fp, rp), (fu, ru) = flat(positive), flat(unlabelled)
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    w = np.zeros(size) if start is None else start
    often = np.bincount(fu, minlength=size) / m + prior * np.bincount(fp, minlength=size) / n  # so that a weight shrinks alike however rare its feature
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        gp = np.bincount(rp, weights=w[fp], minlength=n) + bias
        gu = np.bincount(ru, weights=w[fu], minlength=m) + bias
        # Slopes of l(g) = log(1 + e^-g) at positives, and of l(-g) at both.
        toward, away_p, away_u = -sigmoid(-gp) * prior / n, sigmoid(gp) * prior / n, sigmoid(gu) / m
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative < -beta:
            dp, du = gamma * away_p, -gamma * away_u  # ascend the negative risk
        else:
            dp, du = toward - away_p, away_u
        grad = np.r_[np.bincount(fp, weights=dp[rp], minlength=size) + np.bincount(fu, weights=du[ru], minlength=size) + decay * often * w, dp.sum() + du.sum()]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, max_positives: int = 4000, block_rows: int = 12_000, rounds: int = 2, steps: int = 150, min_df: int = 5, significance: float = 4.0, decay: float = 0.03, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(features, weights, bias), or None without positives."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_toxic"))
    total, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("_toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return None
    ids = sized(written(marks.where("_toxic = 1").select("_id"), "toxic-ids"), BROADCAST_IDS)
    marked = written(docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi").select("text"), "toxic-positives")
    known, df_p, n_p = candidate_features(_weighted(marked, "text"), min_df)
    if not n_p or not len(known):
        return None
    df_u, n_u = document_frequency(_weighted(docs, "text"), known)
    if prior is None:
        prior = toxic / total if toxic < total else min(0.5, n_p / max(1, n_u))
    chance = df_u * n_p / max(1, n_u)  # positives with the feature if it had nothing to do with toxicity
    chosen = np.abs(df_p - chance) >= significance * np.sqrt(chance) + min_df / 2
    known, purity = known[chosen], (prior * df_p[chosen] / n_p) / (df_u[chosen] / max(1, n_u))
    rows = written(feature_rows(docs, known), "toxic-rows")
    positive = _rows_of(written(_sample(marked, "text", max_positives, seed), "toxic-training"), known)
    weights, bias = fit(positive, rows, len(known), prior, rounds=rounds, block_rows=block_rows, steps=steps, decay=decay)
    unseen = np.bincount(np.concatenate([*positive, np.zeros(0, np.int64)]), minlength=len(known)) == 0
    share = np.clip(purity[unseen], 0.01, 0.99)
    weights[unseen] = np.log(share / (1 - share)) - bias
    return known, weights, bias


def toxic(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.0, **options) -> DataFrame:
    """(doc_id, score) of the documents with a score above ``threshold``; the options are those of ``train``."""
    model = train(docs, labels, key=key, text=text, **options)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    known, weights, bias = model

    def run(batch):
        for a, b, h, doc in features(batch.column(1)):
            own, at = _presence(h, doc, known)
            score = sums_by(weights[at], own, b - a) + bias
            some = (np.bincount(doc, minlength=b - a) > 0) & (score > threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["doc_id", "score"]).filter(pa.array(some))

    return arrow_map(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double")
