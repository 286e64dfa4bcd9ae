"""Operator 8: language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each row and each language:

* the text, under a byte-trigram model per language.  The counts are taken over
  all rows that declare the language, in one grouped aggregation, and smoothed
  with the whole corpus's as if by ``smoothing`` trigrams.  However few rows
  declare a language, it has a model;
* the language the markup declares, under P(declared | language);
* the suffix of the address, under P(suffix | language);
* the host, under a prior that backs off host -> domain -> whole corpus
  (each level smoothed with its parent, all counts by grouped aggregation).

A background model with uniform trigrams competes as ``und``.  A row is
rejected if it has no trigram with a letter, if ``und`` wins, or if no language
reaches ``min_confidence``.

Input columns: ``text``, ``declared``, ``suffix``, ``host``, ``domain`` and any
key columns.  Null or empty evidence of one kind counts as absent; a null or
empty text is rejected.  Repeated rows are judged one by one and alike.  Extra
columns are ignored; if no row declares a language, every row is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sized, written
from .textkernel import byte_batches, byte_view, mix64, sums_by

BUCKETS = 1 << 15
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _trigrams(raw: np.ndarray, offsets: np.ndarray):
    """Bucket of every byte trigram that starts and ends within a text and has a letter, and its text."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
    packed = (r[:-2] << 16) | (r[1:-1] << 8) | r[2:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (doc[:-2] == doc[2:]) & (packed != 0x202020)
    return ((packed[ok] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), doc[:-2][ok]


def count_trigrams(rows: DataFrame) -> DataFrame:
    """(declared, bucket, n): trigram counts per declared language."""

    def run(batches):
        tables: dict[str, np.ndarray] = {}

        def flush():
            for name, t in tables.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(t[at])], names=["declared", "bucket", "n"])
            tables.clear()

        for batch in batches:
            langs = np.array([x or "" for x in batch.column(0).to_pylist()])
            texts = batch.column(1)
            for a, b in byte_batches(texts):
                raw, off = byte_view(texts.slice(a, b - a))
                grams, doc = _trigrams(raw, off)
                names, code = np.unique(langs[a:b], return_inverse=True)
                hist = np.bincount(code[doc] * BUCKETS + grams, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, own in zip(names, hist):
                    if name:
                        tables[name] = tables[name] + own if name in tables else own.copy()
            if len(tables) > 200:
                yield from flush()
        yield from flush()

    parts = rows.select("declared", "text").mapInArrow(run, "declared string, bucket int, n long")
    return parts.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def _fit(counts: DataFrame, smoothing: float) -> tuple[list[str], str]:
    """The languages, sorted, and the folder of their tables of log probabilities, each made by a task of its own."""
    counts = written(counts, "langid-counts")
    corpus = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row a bucket at most
    share = np.full(BUCKETS, 0.1)
    share[corpus.bucket.to_numpy()] += corpus.n.to_numpy()
    share *= smoothing / share.sum()

    def run(key, table):
        n = np.full(BUCKETS, 0.1)
        n[table["bucket"].to_numpy()] += table["n"].to_numpy()
        n += share
        return pa.table({"declared": [key[0].as_py()], "table": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    tables = written(counts.groupBy("declared").applyInArrow(run, "declared string, table binary"), "langid-tables")
    files = tables.inputFiles()
    return sorted(r.declared for r in tables.select("declared").collect()), files[0].rpartition("/")[0] if files else ""


_loaded: dict[str, list[np.ndarray]] = {}


def _tables(folder: str) -> list[np.ndarray]:
    """The tables in a folder, in order of the languages; each worker process reads them once."""
    if folder not in _loaded:
        _loaded.clear()
        fs, path = pafs.FileSystem.from_uri(folder)
        rows = pads.dataset(path, filesystem=fs, format="parquet").to_table().sort_by("declared")
        _loaded[folder] = [np.frombuffer(x.as_buffer(), np.float32) for x in rows["table"]]
    return _loaded[folder]


def _score(rows: DataFrame, keys: list[str], folder: str, weight: float) -> DataFrame:
    """Keys, evidence columns, and the weighted log likelihood of the text under each language and then ``und``."""
    fields = [rows.schema[k] for k in [*keys, "declared", "suffix", "host", "domain"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", grams long, ll array<double>, best int"
    width = len(fields)

    def run(batch):
        tables = _tables(folder)
        texts = batch.column(width)
        for a, b in byte_batches(texts):
            raw, off = byte_view(texts.slice(a, b - a))
            grams, doc = _trigrams(raw, off)
            n = np.bincount(doc, minlength=b - a)
            ll = np.stack([*(sums_by(t[grams], doc, b - a) for t in tables), -np.log(BUCKETS) * n], axis=1) * weight
            best = ll.argmax(axis=1)
            part = [c.slice(a, b - a) for c in batch.columns[:width]]
            flat = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * ll.shape[1], pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*part, pa.array(n.astype(np.int64)), flat, pa.array(best.astype(np.int32))], names=[*(f.name for f in fields), "grams", "ll", "best"])

    return arrow_map(rows.select(*keys, "declared", "suffix", "host", "domain", "text"), run, schema)


def _evidence(scored: DataFrame, column: str, languages: int) -> dict[str, np.ndarray]:
    """log P(value | language) for the values of a column, from the languages that the texts alone suggest."""
    seen = scored.where(F.col(column).isNotNull() & (F.col("grams") > 0) & (F.col("best") < languages)).groupBy(column, "best").agg(F.count(F.lit(1)).alias("n"))
    table = seen.toPandas()  # values are two- and three-letter codes: bounded
    values = sorted(table[column].unique()) if len(table) else []
    m = np.full((len(values), languages), 0.5)
    for v, j, n in table.itertuples(index=False):
        m[values.index(v), j] += n
    m = np.log(m / (m.sum(axis=0) + 0.5))
    return dict(zip(values, m))


def host_priors(scored: DataFrame, languages: int, strength: float) -> tuple[DataFrame, np.ndarray]:
    """log P(language | host) for each (domain, host), smoothed with the domain's, smoothed with the corpus's."""
    one_hot = [F.sum(F.when(F.col("best") == j, 1.0).otherwise(0.0)).alias(f"n{j}") for j in range(languages)]
    hosts = written(scored.where((F.col("grams") > 0) & (F.col("best") < languages)).groupBy("domain", "host").agg(*one_hot), "langid-hosts")
    total = np.array(hosts.agg(*(F.coalesce(F.sum(f"n{j}"), F.lit(0.0)) for j in range(languages))).first(), float)
    root = (total + 0.5) / (total.sum() + 0.5 * languages)
    per_domain = hosts.groupBy("domain").agg(*(F.sum(f"n{j}").alias(f"d{j}") for j in range(languages)))

    def smooth(prefix: str, parents: list) -> list:
        n = sum((F.col(f"{prefix}{j}") for j in range(languages)), F.lit(0.0))
        return [(F.col(f"{prefix}{j}") + strength * parents[j]) / (n + strength) for j in range(languages)]

    domains = per_domain.select("domain", *(x.alias(f"p{j}") for j, x in enumerate(smooth("d", [F.lit(float(r)) for r in root]))))
    joined = hosts.join(domains, hosts["domain"].eqNullSafe(domains["domain"])).drop(domains["domain"])
    own = F.array(*(F.log(x) for x in smooth("n", [F.col(f"p{j}") for j in range(languages)])))
    return joined.select(F.col("domain").alias("h_domain"), F.col("host").alias("h_host"), own.alias("prior")), np.log(root)


def identify(rows: DataFrame, keys: list[str], **options) -> DataFrame:
    """Keys, ``lang`` and ``confidence`` of every row that isn't rejected; the options are those of ``classify``."""
    return classify(rows, keys, **options).where(F.col("lang").isNotNull())


def classify(rows: DataFrame, keys: list[str], *, min_confidence: float = 0.5, smoothing: float = 500.0, weight: float = 0.3, strength: float = 20.0, und_prior: float = 1e-3) -> DataFrame:
    """Keys, ``lang`` (null: rejected) and ``confidence`` of every row."""
    code = F.regexp_extract(F.lower(F.trim("declared")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    rows = rows.withColumn("declared", F.when(code != "", code)).withColumn("suffix", F.when(F.col("suffix").rlike(r"^[a-z0-9]{2,3}$"), F.col("suffix")))
    langs, folder = _fit(count_trigrams(rows), smoothing)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[k] for k in keys))
    if not langs:
        return rows.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    n = len(langs)
    scored = written(_score(rows, keys, folder, weight), "langid-scored")
    declared, suffix = _evidence(scored, "declared", n), _evidence(scored, "suffix", n)
    priors, root = host_priors(scored, n, strength)
    priors = sized(written(priors, "langid-priors"))
    fused = scored.join(priors, scored["host"].eqNullSafe(priors["h_host"]) & scored["domain"].eqNullSafe(priors["h_domain"]), "left")
    names = np.array([*langs, "und"])
    width = len(keys)
    none = np.zeros(n)

    def run(batch):
        m = batch.num_rows
        ll = np.array(batch.column(width + 3).to_pylist(), float).reshape(m, n + 1)
        prior = np.array([root if x is None else x for x in batch.column(width + 4).to_pylist()], float).reshape(m, n)
        for j, table in ((0, declared), (1, suffix)):
            ll[:, :n] += np.stack([table.get(x, none) for x in batch.column(width + j).to_pylist()])
        ll[:, :n] += prior
        ll[:, n] += np.log(und_prior)
        ll -= ll.max(axis=1, keepdims=True)
        p = np.exp(ll)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ok = (batch.column(width + 2).to_numpy() > 0) & (best < n) & (p.max(axis=1) >= min_confidence)
        yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names[best].astype(object), pa.string(), mask=~ok), pa.array(p.max(axis=1))], names=[*keys, "lang", "confidence"])

    return arrow_map(fused.select(*keys, "declared", "suffix", "grams", "ll", "prior"), run, f"{kinds}, lang string, confidence double")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of the documents table: the declared language is its ``lang``, the host its ``source``."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of the pages table: the ``lang`` attribute of the markup, the address's last label, host and domain."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>|<[^>]*>", " ")
    declared = F.regexp_extract(F.col("html"), r"(?i)<html[^>]*\blang=[\"']?([A-Za-z_-]+)", 1)
    return pages.select(
        "page_id", text.alias("text"), declared.alias("declared"),
        F.regexp_extract(host, r"\.([a-z]{2,3})$", 1).alias("suffix"), F.when(host != "", host).alias("host"), F.when(host != "", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )
