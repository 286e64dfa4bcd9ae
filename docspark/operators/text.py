"""Full-text search: BM25 in two tokenisations, chunking and near-duplicate removal.

A search reads the corpus once: documents that hold no query term only add to
the two corpus statistics, and only query terms are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from .graph import TASK_ROWS, sized, written


def _query_terms(df: DataFrame, query: str, tokens) -> list[str]:
    return df.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def _frequency(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(df: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", tokens=scalars.tokens_unicode, k1: float = 1.5, b: float = 0.75, limit: int = 10, digits: int | None = None) -> DataFrame:
    """(key, score), best first, ties by key.  A term that the query repeats adds each time."""
    terms = _query_terms(df, query, tokens)
    if not terms:
        return df.limit(0).select(key, F.lit(0.0).alias("score"))
    words = df.select(key, tokens(text).alias("_t"))
    counted = words.select(key, F.size("_t").alias("_n"), *(_frequency("_t", t).alias(f"_f{i}") for i, t in enumerate(dict.fromkeys(terms))))
    distinct = list(dict.fromkeys(terms))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("_n").alias("mean"), *(F.sum((F.col(f"_f{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(distinct))))
    hit = F.lit(False)
    for i in range(len(distinct)):
        hit = hit | (F.col(f"_f{i}") > 0)
    scored = counted.where(hit).crossJoin(F.broadcast(stats))  # one row
    total: Column = F.lit(0.0)
    for i, term in enumerate(distinct):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col(f"_f{i}")
        total = total + terms.count(term) * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("mean")))
    score = F.round(total, digits) if digits is not None else total
    out = scored.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out


def text_index_search(df: DataFrame, query: str, **options) -> DataFrame:
    """BM25 over ASCII words: k1 1.2, four digits, 20 rows."""
    return bm25(df, query, **({"tokens": scalars.tokens_ascii, "k1": 1.2, "limit": 20, "digits": 4} | options))


def search(df: DataFrame, query: str, **options) -> DataFrame:
    """BM25 over words of any script without stop words: k1 1.5, 10 rows."""
    return bm25(df, query, **options)


def ngrams(c: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams, lower-cased; a shorter text is its own."""
    t = F.lower(scalars.col(c))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.array_distinct(whole)


def contains_all_ngrams(df: DataFrame, field: str, query: str, n: int = 3) -> DataFrame:
    """Rows that have every n-gram of the query."""
    wanted = list(dict.fromkeys(query.lower()[i : i + n] for i in range(max(1, len(query) - n + 1))))
    return df.where(F.size(F.array_except(F.lit(wanted), ngrams(field, n))) == 0) if len(query) >= n else df.where(F.lower(field).contains(query.lower()))


def chunk(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk, text): one row a piece."""
    return df.select(key, F.posexplode(scalars.chunks(text, size, overlap)).alias("chunk", "text"))


def drop_near_duplicates(df: DataFrame, *, by: list[str], rank: str, text: str = "text", least: float = 0.85) -> DataFrame:
    """Greedy within each group in order of rank: a text goes if a kept one resembles it by ``least`` or more.

    A group is one result list (a query's hits), so its texts fit a row.  Blank texts go.
    """
    columns = df.columns
    rows = df.where(F.length(F.trim(text)) > 0)
    gathered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("_rank"), F.struct(*columns).alias("_row")))).alias("_all"))
    kind = T.ArrayType(gathered.schema["_all"].dataType.elementType)
    keep = F.aggregate("_all", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: scalars.word_jaccard(k["_row"][text], x["_row"][text]) >= least), kept).otherwise(F.concat(kept, F.array(x))))
    return gathered.select(F.explode(keep).alias("_x")).select("_x._row.*")


def pack_budget(df: DataFrame, *, by: list[str], rank: str, text: str = "text", budget: int = 1500, whole: int = 2, least: int = 40) -> DataFrame:
    """Texts of each group, in order of rank, that fit a token budget: (by, rank, text, tokens, trimmed).

    The first ``whole`` go in if they fit; others while tokens are left, the one that doesn't fit cut in proportion
    (less a tenth); nothing is added with fewer than ``least`` tokens left, nor after a cut.
    """
    rows = df.where(F.length(F.trim(text)) > 0).select(*by, rank, F.trim(text).alias("_text"), scalars.estimate_tokens(F.trim(text)).alias("_tokens"))
    gathered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col("_text").alias("text"), F.col("_tokens").alias("tokens")))).alias("_texts"))
    rank_type = df.schema[rank].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<rank:{rank_type},text:string,tokens:int,trimmed:boolean>>").alias("out"), F.lit(0).alias("used"), F.lit(0).alias("i"), F.lit(False).alias("done"))

    def step(s, x):
        left = F.lit(budget) - s["used"]
        early = s["i"] < whole
        fits = x["tokens"] <= left
        cut = F.concat(F.substring(x["text"], F.lit(1), F.floor(F.length(x["text"]) * left / x["tokens"] * 0.9).cast("int")), F.lit("... [trimmed]"))
        cut_tokens = scalars.estimate_tokens(cut)
        take = ~s["done"] & ((early & fits) | ((left >= least) & fits))
        trim = ~s["done"] & ~take & (left >= least)
        stop = s["done"] | trim | ((left > 0) & (left < least) & ~take)
        row = F.struct(x["rank"].alias("rank"), F.when(take, x["text"]).otherwise(cut).alias("text"), F.when(take, x["tokens"]).otherwise(cut_tokens).alias("tokens"), trim.alias("trimmed"))
        return F.struct(
            F.when(take | trim, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"),
            (s["used"] + F.when(take, x["tokens"]).when(trim, cut_tokens).otherwise(0)).alias("used"), (s["i"] + 1).alias("i"), stop.alias("done"),
        )

    packed = gathered.select(*by, F.aggregate("_texts", start, step).alias("_p"))
    return packed.select(*by, F.explode("_p.out").alias("_x")).select(*by, "_x.*")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str, *, task_rows: int = TASK_ROWS) -> DataFrame:
    """1-based rank of each row within ``by``, whose values may have any share of the rows.

    Rows are written, then sorted over ranges of at most about ``task_rows``: a row's place in its range, less that of
    the first row of its ``by`` there, and the rows of that ``by`` in the ranges before give the rank.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows = written(rows, "rank-rows")
    n = rows.count()
    if n <= task_rows:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // task_rows))
    keys = [*(F.col(c) for c in by), *order]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "rank-places")  # of the same ranges for the counts and for the ranks
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(*(f"_b_{c}" for c in by)).orderBy("_b_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*(F.col(c).alias(f"_b_{c}") for c in by), part.alias("_b_part")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    offsets = counts.select(*(f"_b_{c}" for c in by), "_b_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    on = part == F.col("_b_part")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return placed.join(sized(written(offsets, "rank-offsets")), on).select(*columns, (place + F.col("_offset")).alias(name))


def rrf(lists: DataFrame, *, name: str = "list", key: str = "doc_id", score: str = "score", k: int = 60, weights: dict[str, float] | None = None, by: list[str] | None = None, digits: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (one DataFrame, a row a hit): (by, key, rrf_score)."""
    by = by or []
    weight: Column = F.lit(1.0)
    for n, w in (weights or {}).items():
        weight = F.when(F.col(name) == n, F.lit(float(w))).otherwise(weight)
    hits = ranked(lists.select(*by, name, key, score), [*by, name], [F.desc(score), F.asc(key)], "_rank", task_rows=task_rows).withColumn("_part", weight / (k + F.col("_rank")))
    total = F.sum("_part")
    return hits.groupBy(*by, key).agg((F.round(total, digits) if digits is not None else total).alias("rrf_score"))
