"""Sparse, dense and late-interaction retrieval, rank fusion and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.operators.similarity import max_sim, nearest

K1, B = 1.2, 0.75
RRF_K = 60


#: Terms of all queries up to this number are broadcast to the documents' words; more are joined by a shuffle.
FEW_TERMS = 200_000


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): lower-case words of letters and digits of the texts that have any."""
    return df.select(key, F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)


def bm25_topk(queries: DataFrame, docs: DataFrame, query_key: str, key: str, query_text: str, text: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each query: (query_key, key, score, rank); ties by key.

    The documents' words are shuffled once, by document; what is made of them, a
    row for each query that a term meets, is summed where its document is.
    """
    split = words_of(docs, key, text)
    sizes = split.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean_length"))
    wanted = words_of(queries, query_key, query_text).select(query_key, F.explode("w").alias("term")).distinct()
    # Only the queries' terms go on from the documents' words, before anything is counted.
    few = wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    small = F.broadcast if few else lambda x: x
    every = split.repartition(F.col(key)).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    hits = every.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    w = hits.join(small(df), "term").crossJoin(F.broadcast(sizes))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = w.select(key, "term", weight.alias("w")).join(small(wanted), "term").groupBy(query_key, key).agg(F.round(F.sum("w"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k).select(query_key, key, "score", "rank")


def rrf(rankings: list[DataFrame], query_key: str, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_key, key, rank)."""
    every = None
    for r in rankings:
        part = r.select(query_key, key, (1.0 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(query_key, key).agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= limit)


def rerank(candidates: list[DataFrame], queries: DataFrame, docs: DataFrame, query_key: str, key: str, query_late: str, late: str, limit: int) -> DataFrame:
    """The union of candidate lists, ranked by late interaction."""
    every = None
    for c in candidates:
        part = c.select(query_key, key)
        every = part if every is None else every.unionByName(part)
    pairs = every.distinct().join(queries.select(query_key, F.col(query_late).alias("__q")), query_key).join(docs.select(key, F.col(late).alias("__d")), key)
    scored = pairs.select(query_key, key, F.round(max_sim(F.col("__q"), F.col("__d")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= limit)


def plan(dense: bool, sparse: bool, late: bool) -> str:
    """rerank, fusion or single; late interaction needs another ranking to rerank."""
    n = dense + sparse
    if n == 0:
        raise ValueError("a dense or a sparse ranking is needed")
    return "rerank" if late else "fusion" if n == 2 else "single"


def retrieve(queries: DataFrame, docs: DataFrame, query_key: str, key: str, *, dense: tuple[str, str] | None = None, sparse: tuple[str, str] | None = None, late: tuple[str, str] | None = None, limit: int = 10, prefetch: int = 20) -> DataFrame:
    """Hybrid retrieval: each pair names the queries' and the documents' column."""
    how = plan(dense is not None, sparse is not None, late is not None)
    n = limit if how == "single" else prefetch
    lists = []
    if dense:
        lists.append(nearest(queries, docs, query_key, key, *dense, n))
    if sparse:
        lists.append(bm25_topk(queries, docs, query_key, key, *sparse, n))
    if how == "single":
        return lists[0]
    return rrf(lists, query_key, key, limit) if how == "fusion" else rerank(lists, queries, docs, query_key, key, *late, limit)


def numbered_context(results: DataFrame, query_key: str, text: str, queries: DataFrame | None = None) -> DataFrame:
    """Per query its results as one numbered text; with queries given, "(no context)" for those without results."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["t"]))
    found = results.groupBy(query_key).agg(F.array_join(parts, "\n\n").alias("context"))
    return found if queries is None else queries.select(query_key).join(found, query_key, "left").withColumn("context", F.coalesce("context", F.lit("(no context)")))
