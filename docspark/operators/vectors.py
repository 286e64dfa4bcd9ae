"""Vector search, quantisation, hashed embeddings, and retrieval built of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from . import text as texts


def knn(df: DataFrame, query: list[float], k: int = 10, *, vector: str = "embedding", key: str = "vec_id", metric: str = "cosine", spec: dict | None = None) -> DataFrame:
    """The k best rows with ``score`` (cosine; negative distance otherwise).  A filter applies before the top-k."""
    from .filters import find

    df = find(df, spec)
    q = F.array(*(F.lit(float(x)) for x in query))
    score = {"cosine": lambda: scalars.cosine(vector, q), "euclidean": lambda: 0 - scalars.euclidean(vector, q), "dot": lambda: scalars.dot(F.col(vector), q)}[metric]()
    return df.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def knn_join(queries: DataFrame, df: DataFrame, k: int = 10, *, query_key: str, query_vector: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows of each query by cosine: (query_key, key, score), exact.

    Vectors are normalised once per side.  Each pair of blocks is scored by one matrix product, and each keeps only
    its k best, so what is shuffled is queries x blocks x k rows.
    """
    spark = df.sparkSession
    side = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<float>").alias("qv"))
    v = df.select(F.col(key).alias("v"), F.col(vector).cast("array<float>").alias("vv")).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(side)).cast("int"))
    spread = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    qt, vt = (d.schema[c].dataType.simpleString() for d, c in ((q, "q"), (v, "v")))

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        lists = table[name].combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def best(left, right):
        ids, found = right["v"], []
        if not len(left) or not len(right):
            return pa.table({"q": left["q"].slice(0, 0), "v": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        a, b = matrix(left, "qv"), matrix(right, "vv")
        n = min(k, len(b))
        for i in range(0, len(a), 1024):
            s = a[i : i + 1024] @ b.T
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            found.append((np.repeat(np.arange(i, i + len(s)), n), top.ravel(), np.take_along_axis(s, top, 1).ravel()))
        rows, columns, scores = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": left["q"].take(pa.array(rows)), "v": ids.take(pa.array(columns)), "score": pa.array(scores)})

    from pyspark.sql import Window

    found = spread.groupBy("block").cogroup(v.groupBy("block")).applyInArrow(best, f"q {qt}, v {vt}, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).select(F.col("q").alias(query_key), F.col("v").alias(key), "score")


def sq8(v: Column | str) -> Column:
    """8-bit quantisation: struct of the codes (0 to 255), the minimum and the step."""
    v = scalars.col(v)
    low = F.array_min(v).cast("double")
    step = (F.array_max(v).cast("double") - low) / 255
    codes = F.transform(v, lambda x: F.when(step == 0, 0).otherwise(F.floor((x.cast("double") - low) / step + 0.5)).cast("int"))
    return F.struct(codes.alias("codes"), low.alias("low"), step.alias("step"))


def sq8_restore(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c * q["step"] + q["low"])


def sq8_cosine(q: Column, query: Column) -> Column:
    """Cosine of a float query with a quantised vector."""
    return scalars.cosine(sq8_restore(q), query)


def one_bit(v: Column | str) -> Column:
    """Sign bits packed in 32-bit words (as longs), the first value in the lowest bit."""
    v = scalars.col(v)
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1)
    powers = F.lit([1 << k for k in range(32)]).cast("array<long>")

    def pack(w):
        part = F.slice(v, w * 32 + 1, F.lit(32))
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.element_at(powers, i + 1)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.transform(words, pack)


def one_bit_similarity(a: Column, b: Column, dimensions: int) -> Column:
    """cos(pi * d / D) of the Hamming distance d."""
    return F.cos(F.lit(float(np.pi)) * scalars.hamming(a, b) / dimensions)


def memory_estimate(n: Column, dimensions: int) -> Column:
    """Bytes as float32, 8-bit and 1-bit vectors."""
    words = -(-dimensions // 32)
    return F.struct((n * dimensions * 4).alias("float32"), (n * (dimensions + 16)).alias("sq8"), (n * (words * 4 + 8)).alias("one_bit"))


_FNV, _WORD = np.uint64(0x01000193), np.uint64(0xFFFFFFFF)


#: Characters that are embedded at once; a longer text is by itself.
_SLICE = 1 << 17


def _embed(texts: list[str | None], dimensions: int) -> np.ndarray:
    """A row a text."""
    words = [(t or "").lower().split() for t in texts]
    w = np.array([len(x) for x in words], np.int64)
    size = np.array([len(y) for x in words for y in x], np.int64)
    codes = np.frombuffer("".join(y for x in words for y in x).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of_word = np.repeat(np.arange(len(texts)), w)
    n = np.bincount(of_word, size, len(texts)).astype(np.int64)
    total = w + np.maximum(0, 2 * n - 3) * (n > 0)
    base = np.cumsum(total) - total
    out = np.zeros((len(texts), dimensions))
    if not len(codes):
        return out
    start = np.cumsum(size) - size
    hashed = np.full(len(size), 0x811C9DC5, np.uint64)
    alive = np.arange(len(size))
    for j in range(int(size.max())):
        alive = alive[size[alive] > j]
        hashed[alive] = (hashed[alive] ^ codes[start[alive] + j]) * _FNV & _WORD
    h = np.empty(int(total.sum()), np.uint64)
    h[base[of_word] + np.arange(len(size)) - (np.cumsum(w) - w)[of_word]] = hashed
    # After a text's words come the 2- and the 3-gram at each character.
    of_code = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(codes)) - (np.cumsum(n) - n)[of_code]
    spot, left = (base + w)[of_code] + 2 * at, n[of_code] - at
    one = (np.uint64(0x811C9DC5) ^ codes) * _FNV & _WORD
    two = (one[:-1] ^ codes[1:]) * _FNV & _WORD
    three = (two[:-1] ^ codes[2:]) * _FNV & _WORD
    i, k = np.flatnonzero(left > 1), np.flatnonzero(left > 2)
    h[spot[i]], h[spot[k] + 1] = two[i], three[k]
    signed = h.astype(np.uint32).view(np.int32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), total)
    out = np.bincount(of * dimensions + np.abs(signed) % dimensions, 1 / np.sqrt(np.arange(1, len(h) + 1) - base[of]), len(texts) * dimensions).reshape(-1, dimensions)
    return out / np.array([np.linalg.norm(x) or 1.0 for x in out])[:, None]


def _slices(texts: list[str | None]):
    """Runs of texts of up to ``_SLICE`` characters, or one."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > _SLICE and i > begin:
            yield texts[begin:i]
            begin, held = i, len(t or "")
    yield texts[begin:]


def embed(c: Column | str, dimensions: int = 64) -> Column:
    """Hashed embedding of words and character 2- and 3-grams, of unit length; an Arrow UDF."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([x for part in _slices(batch.tolist()) for x in _embed(part, dimensions)], dtype=object)

    return run(scalars.col(c))


def embed_text(text: str, dimensions: int = 64) -> list[float]:
    return _embed([text], dimensions)[0].tolist()


def hybrid(df: DataFrame, query: str, query_vector: list[float], *, key: str = "doc_id", text: str = "text", vector: str = "vector", k: int = 5, budget: int | None = None) -> DataFrame:
    """Vector and BM25 top-2k fused by reciprocal rank; the best k with their texts, packed to a budget if given."""
    by_vector = knn(df, query_vector, 2 * k, vector=vector, key=key).select(F.lit("vector").alias("list"), key, "score")
    by_text = texts.search(df, query, key=key, text=text, limit=2 * k).select(F.lit("text").alias("list"), key, "score")
    fused = texts.rrf(by_vector.unionByName(by_text), key=key).orderBy(F.desc("rrf_score"), key).limit(k)
    out = df.select(key, text).join(F.broadcast(fused), key)  # k rows
    if budget is None:
        return out
    ranked = out.withColumn("_all", F.lit(0)).withColumn("_rank", -F.col("rrf_score"))
    return texts.pack_budget(ranked, by=["_all"], rank="_rank", text=text, budget=budget).drop("_all")


def rag_ingest(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64, dimensions: int = 64) -> DataFrame:
    """(key, chunk, text, vector)."""
    return texts.chunk(df, key=key, text=text, size=size, overlap=overlap).withColumn("vector", embed("text", dimensions))


def rag_ask(chunks: DataFrame, question: str, *, key: str = "doc_id", k: int = 4, budget: int = 1500, dimensions: int = 64) -> DataFrame:
    """The chunks nearest to a question, packed to a token budget."""
    rows = chunks.withColumn("_id", F.concat_ws("#", F.col(key).cast("string"), F.col("chunk").cast("string")))
    best = knn(rows, embed_text(question, dimensions), k, vector="vector", key="_id")
    return texts.pack_budget(best.withColumn("_all", F.lit(0)).withColumn("_rank", -F.col("score")), by=["_all"], rank="_rank", budget=budget).drop("_all")


def vault(df: DataFrame, *, key: str = "doc_id", text: str = "text", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(vectors with text digests only, texts), joined again by key on the owner's side."""
    return df.select(key, vector, F.sha2(F.col(text), 256).alias("digest")), df.select(key, text)


def recall(memories: DataFrame, query_vector: list[float], now_ms: int, *, k: int = 5, vector: str = "vector", key: str = "_id") -> DataFrame:
    """Memories that haven't expired, by similarity x importance x recency."""
    live = memories.where(F.col("expiresAt").isNull() | (F.col("expiresAt") > now_ms))
    near = knn(live, query_vector, 3 * k, vector=vector, key=key)
    hours = (F.lit(now_ms) - F.col("createdAt")) / 3_600_000.0
    return near.withColumn("relevance", F.col("score") * F.col("importance") * scalars.recency(hours)).orderBy(F.desc("relevance"), key).limit(k)


def shared_recall(memories: DataFrame, query_vector: list[float], now_ms: int, *, agents: list[str] | None = None, k: int = 5, **options) -> DataFrame:
    """One row with the recalled texts of several agents joined."""
    if agents:
        memories = memories.where(F.col("agent").isin(agents))
    best = recall(memories, query_vector, now_ms, k=k, **options)
    return best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), F.col("text").alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def cache_lookup(prompts: DataFrame, cache: DataFrame, now_ms: int, *, ttl_ms: int = 3_600_000, least: float = 0.92, key: str = "prompt_id") -> DataFrame:
    """Each prompt's cached answer: an equal prompt's, else the nearest one's if it is near enough and fresh.

    prompts: key, prompt, vector.  cache: entry_id, prompt, vector, response, createdAt.
    """
    fresh = cache.where(F.lit(now_ms) - F.col("createdAt") <= ttl_ms)
    exact = fresh.groupBy("prompt").agg(F.max_by("response", F.struct("createdAt", "entry_id")).alias("exact"))
    near = knn_join(prompts, fresh, 1, query_key=key, query_vector="vector", vector="vector", key="entry_id").where(F.col("score") >= least)
    near = near.join(fresh.select("entry_id", F.col("response").alias("near")), "entry_id").select(key, "near", "score")
    out = prompts.join(exact, "prompt", "left").join(near, key, "left")
    return out.select(key, F.coalesce("exact", "near").alias("response"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "semantic").otherwise("miss").alias("tier"))
