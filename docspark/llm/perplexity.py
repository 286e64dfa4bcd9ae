"""Operator 2: quality rules by n-gram perplexity.

For each language a modified Kneser-Ney model of byte 5-grams is counted over
all documents: distinct 5-grams of each batch by numpy, summed by a grouped
aggregation.  Lower orders need no further counts: their adjusted counts are
the numbers of distinct left extensions.  A language's model is kept as arrays
sorted by the hashes of its packed n-grams (the hash is a bijection, so equal
hashes are equal n-grams), with their probabilities and back-off weights,
written to the shared folder; workers load the languages they meet and find
n-grams by their hashes' leading bits.

A document's perplexity is that per byte.  Its language's band is
[median - ``spread`` * sigma(n), median + ``spread`` * sigma(n)] in log
perplexity, where the median is taken over the language's documents, and
sigma(n) is a robust spread of documents of about as many bytes (powers of
two), drawn down towards that of neighbouring sizes as if by ``strength``
documents, so that a sparse size isn't its own yardstick, and never under
``floor``.  A language of few documents has a wider band, by the factor
sqrt(1 + ``strength`` / documents).

A model that has counted junk predicts junk.  So the counts are taken
``rounds`` times more, each time over all documents that lie within ``inner``
sigmas by the model before; every round scores all documents.  Documents
that repeat predictable words then fall below the band, noise lands above it;
both are rejected.

Null and empty texts are rejected.  A null language is the same as an empty
one, a language of its own.  Repeated rows and repeated or null keys are judged
row by row.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, sized, written
from .textkernel import U64, byte_batches, byte_view, mix64, sums_by

ORDER = 5
KINDS = [f"{k}{n}" for n in range(1, ORDER + 1) for k in "gpcb"]


def packed(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each byte; bytes before the text are 0."""
    out = raw.astype(U64)
    for j in range(1, ORDER):
        shifted = np.zeros(len(raw), np.uint8)
        shifted[j:] = raw[:-j] if j < len(raw) else raw[:0]
        for t in range(j):
            at = offsets[:-1] + t
            shifted[at[at < np.minimum(offsets[1:], len(raw))]] = 0
        out |= shifted.astype(U64) << U64(8 * j)
    return out


def count_ngrams(docs: DataFrame, lang: str, text: str, folder: str = "", limits: dict[tuple[str, int], tuple[float, float]] | None = None) -> DataFrame:
    """(lang, gram, n) over all documents, or all that lie within ``limits`` by the models in a folder; languages as text, null as ''."""

    def central(name: str, raw: np.ndarray, off: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Flags of the bytes whose documents lie within their limits."""
        size = np.diff(off)
        mean = -sums_by(log_probabilities(load(folder, name), grams), np.repeat(np.arange(len(size)), size), len(size)) / np.maximum(size, 1)
        band = np.array([limits.get((name, max(1, int(n)).bit_length() - 1), (0.0, -1.0)) for n in size])
        return np.repeat((mean >= band[:, 0]) & (mean <= band[:, 1]), size)

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        def flush():
            for name, parts in held.items():
                keys, n = merge(parts)
                for a in range(0, len(keys), 1 << 17):
                    k = keys[a : a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.view(np.int64)), pa.array(n[a : a + (1 << 17)])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            names = np.array([x or "" for x in batch.column(0).to_pylist()])
            for name in np.unique(names):
                own = batch.column(1).filter(pa.array(names == name))
                for a, b in byte_batches(own, 2 << 20):
                    raw, off = byte_view(own.slice(a, b - a), lower=False)
                    grams = packed(raw, off)
                    if limits is not None and len(raw):
                        grams = grams[central(str(name), raw, off, grams)]
                    if len(grams):
                        grams = np.sort(grams)
                        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                        parts = held.setdefault(str(name), [])
                        parts.append((grams[first], np.diff(np.r_[first, len(grams)])))
                        size += len(first)
                        if len(parts) >= 8:
                            held[str(name)] = [merge(parts)]
            if size > 4_000_000:
                size = sum(len(k) for parts in held.values() for k, _ in parts)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = docs.select(lang, text).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _group_sums(keys: np.ndarray, *values: np.ndarray):
    """Distinct sorted keys, index of the distinct key of each row, and sums of the values."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)])), [np.add.reduceat(v, first) for v in values]


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Interpolated modified Kneser-Ney from the counts of sorted distinct 5-grams.

    g{n}, p{n}: hashes of n-grams, sorted, and log probabilities; c{n}, b{n}: those
    of contexts of n-grams, and log back-off weights.
    """
    levels = {ORDER: (grams, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):
        suffix = np.sort(levels[n + 1][0] & U64((1 << 8 * n) - 1))
        first = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
        levels[n] = (suffix[first], np.diff(np.r_[first, len(suffix)]).astype(np.float64))
    model: dict[str, np.ndarray] = {}
    lower = None
    for n in range(1, ORDER + 1):
        keys, c = levels[n]
        n1, n2, n3, n4 = (max(1, int((c == k).sum())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.95, 1.9, 2.85])
        d[1:] = np.maximum(d[1:], 0.05)
        kind = np.minimum(c, 3).astype(int)
        contexts, of, (total, taken) = _group_sums(keys >> U64(8), c, d[kind])
        gamma = taken / total
        below = np.full(len(keys), 1 / 256) if n == 1 else np.exp(lower[np.searchsorted(levels[n - 1][0], keys & U64((1 << 8 * (n - 1)) - 1))])
        lower = np.log((c - d[kind]) / total[of] + gamma[of] * below)
        for kind, grams_, values in (("gp", keys, lower), ("cb", contexts, np.log(gamma))):
            hashes = mix64(grams_)
            order = np.argsort(hashes)
            model |= {f"{kind[0]}{n}": hashes[order], f"{kind[1]}{n}": values[order]}
    return model


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the sorted hashes with each value of their leading bits start; about a hash a value."""
    bits = max(1, len(keys).bit_length())
    return np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits))


def _find(keys: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted hashes; -1 where it isn't there."""
    bits = len(starts).bit_length() - 1
    out = np.full(len(hashes), -1, np.int64)
    at = starts[(hashes >> U64(64 - bits)).astype(np.int64)]
    todo = np.arange(len(hashes))
    while len(todo):
        inside = at < len(keys)
        held = keys[np.minimum(at, len(keys) - 1)]
        hit = inside & (held == hashes)
        out[todo[hit]] = at[hit]
        on = inside & (held < hashes)
        todo, at, hashes = todo[on], at[on] + 1, hashes[on]
    return out


def _direct(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the sorted hashes with each value of the leading bits, and its value; two to four places a hash."""
    bits = max(1, len(hashes).bit_length()) + 1
    place = (hashes >> U64(64 - bits)).astype(np.int64)[::-1]
    keys, held = np.zeros(1 << bits, U64), np.zeros(1 << bits)
    keys[0] = (1 << 64) - 1  # a hash that belongs elsewhere, as 0 does in all other places
    keys[place], held[place] = hashes[::-1], values[::-1]
    return keys, held


def log_probabilities(model: dict[str, np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Log probability of the last byte of each 5-gram, backing off where the 5-gram is unknown."""
    if "direct_keys" not in model:
        model["direct_keys"], model["direct_values"] = _direct(model[f"g{ORDER}"], model[f"p{ORDER}"])
    hashes = mix64(grams)
    place = (hashes >> U64(65 - len(model["direct_keys"]).bit_length())).view(np.int64)
    out = model["direct_values"][place]
    at = np.flatnonzero(model["direct_keys"][place] != hashes)
    out[at] = 0.0
    for n in range(ORDER, 0, -1):
        for kind in "gc":
            if f"{kind}{n}_starts" not in model:
                model[f"{kind}{n}_starts"] = _starts(model[f"{kind}{n}"])
        own = grams[at] & U64((1 << 8 * n) - 1)
        i = _find(model[f"g{n}"], model[f"g{n}_starts"], mix64(own))
        known = i >= 0
        out[at[known]] += model[f"p{n}"][i[known]]
        at, own = at[~known], own[~known]
        if not len(at):
            return out
        i = _find(model[f"c{n}"], model[f"c{n}_starts"], mix64(own >> U64(8)))
        out[at] += np.where(i >= 0, model[f"b{n}"][i], 0.0)
    out[at] += np.log(1 / 256)
    return out


def fit(counts: DataFrame) -> str:
    """Writes the models of all languages to the shared folder; a task a language.  Returns the folder."""

    def run(key, table):
        grams = table["gram"].to_numpy().view(U64)
        order = np.argsort(grams)
        model = kneser_ney(grams[order], table["n"].to_numpy()[order])
        return pa.table({"lang": [key[0].as_py() or ""] * len(KINDS), "kind": KINDS, "data": pa.array([model[k].tobytes() for k in KINDS], pa.binary())})

    models = written(counts.groupBy("lang").applyInArrow(run, "lang string, kind string, data binary"), "perplexity-models")
    files = models.inputFiles()
    return files[0].rpartition("/")[0] if files else ""


_loaded: dict[tuple[str, str], dict[str, np.ndarray]] = {}


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The model of a language in a folder, without n-grams if there is none; each worker process reads it once."""
    if (folder, name) not in _loaded:
        for other in [k for k in _loaded if k[0] != folder]:
            del _loaded[other]
        fs, path = pafs.FileSystem.from_uri(folder)
        kinds = {k: np.zeros(0, U64 if k[0] in "gc" else np.float64) for k in KINDS}
        for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(filter=pads.field("lang") == name, batch_size=1):
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                kinds[kind] = np.frombuffer(data.as_buffer(), kinds[kind].dtype)
        _loaded[folder, name] = {k: v if len(v) else np.array([(1 << 64) - 1], U64) if k[0] in "gc" else np.zeros(1) for k, v in kinds.items()}
    return _loaded[folder, name]


def score(docs: DataFrame, folder: str, key: str, lang: str, text: str) -> DataFrame:
    """(doc_id, lang, bytes, log_perplexity) of every document; null log perplexity where there is no byte."""

    def run(batch):
        names = np.array([x or "" for x in batch.column(1).to_pylist()])
        n, mean = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for name in np.unique(names):
            rows = np.flatnonzero(names == name)
            own = batch.column(2).take(pa.array(rows))
            for a, b in byte_batches(own):
                raw, off = byte_view(own.slice(a, b - a), lower=False)
                if not len(raw):
                    continue
                size = np.diff(off)
                total = sums_by(log_probabilities(load(folder, str(name)), packed(raw, off)), np.repeat(np.arange(b - a), size), b - a)
                n[rows[a:b]], mean[rows[a:b]] = size, -total / np.maximum(size, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(mean, mask=n == 0)], names=["doc_id", "lang", "bytes", "log_perplexity"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    kinds = rows.schema[0].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kinds}, lang string, bytes long, log_perplexity double")


def bands(scored: DataFrame, floor: float, strength: float) -> DataFrame:
    """(band_lang, band_size, median, sigma) of each language and size class."""
    known = scored.where(F.col("log_perplexity").isNotNull()).withColumn("size", F.floor(F.log2(F.greatest("bytes", F.lit(1)))).cast("int")).withColumn("l", F.coalesce("lang", F.lit("")))
    whole = written(known.groupBy("l").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("median"), F.count(F.lit(1)).alias("docs")), "perplexity-medians")
    gap = known.join(sized(whole), "l").withColumn("gap", F.abs(F.col("log_perplexity") - F.col("median")))
    by = written(gap.groupBy("l", "size", "median", "docs").agg(F.percentile_approx("gap", 0.5, 10_000).alias("mad"), F.count(F.lit(1)).alias("n")), "perplexity-classes")
    other = by.select(F.col("l").alias("other_l"), F.col("size").alias("other_size"), F.col("mad").alias("other_mad"), F.col("n").alias("other_n"))
    near = F.col("other_n") * F.pow(F.lit(0.25), F.abs(F.col("size") - F.col("other_size")))
    pairs = by.join(sized(other), (F.col("l") == F.col("other_l")) & (F.col("size") != F.col("other_size")), "left")
    by = pairs.groupBy("l", "size", "median", "docs", "mad", "n").agg((F.sum(near * F.col("other_mad")) / F.sum(near)).alias("around"))
    mad = (F.col("n") * F.col("mad") + strength * F.coalesce("around", "mad")) / (F.col("n") + strength)
    sigma = F.greatest(F.least("mad", mad) * 1.4826, F.lit(floor)) * F.sqrt(1 + strength / F.col("docs"))
    return by.select(F.col("l").alias("band_lang"), F.col("size").alias("band_size"), "median", sigma.alias("sigma"))


def judge(docs: DataFrame, *, key: str = "doc_id", lang: str = "lang", text: str = "text", spread: float = 5.0, inner: float = 2.0, rounds: int = 2, floor: float = 0.01, strength: float = 20.0) -> DataFrame:
    """(doc_id, lang, perplexity, lower, upper, keep) of every document."""
    folder, near = "", None
    for i in range(rounds + 1):
        folder = fit(written(count_ngrams(docs, lang, text, folder, near), "perplexity-counts"))
        scored = written(score(docs, folder, key, lang, text), "perplexity-scores")
        limits = written(bands(scored, floor, strength), "perplexity-bands")
        if i < rounds:  # a row a language and size class
            near = {(r.band_lang, r.band_size): (r.median - inner * r.sigma, r.median + inner * r.sigma) for r in limits.collect()}
    size = F.floor(F.log2(F.greatest("bytes", F.lit(1)))).cast("int")
    out = scored.join(sized(limits), (F.coalesce("lang", F.lit("")) == F.col("band_lang")) & (size == F.col("band_size")), "left")
    lower, upper = F.col("median") - spread * F.col("sigma"), F.col("median") + spread * F.col("sigma")
    keep = F.coalesce(F.col("log_perplexity").between(lower, upper), F.lit(False))
    return out.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp(lower).alias("lower"), F.exp(upper).alias("upper"), keep.alias("keep"))


def accepted(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, perplexity) of the documents within their language's band; the options are those of ``judge``."""
    return judge(docs, **options).where("keep").select("doc_id", "lang", "perplexity")
