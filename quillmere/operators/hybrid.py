"""Fusion of ranked lists, search modes, reranking, display scores and margins.

A ranked list is (query, doc, rank, score). Missing ranks stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.sizes import maybe_broadcast
from quillmere.functions.text import analyze
from quillmere.operators.sparse import top_k

FAR = 1e9


def _channels(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query, doc, dense_rank, dense_score, sparse_rank, sparse_score): a full outer join as a union and one grouping."""
    d = dense.select("query", "doc", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"), F.lit(None).cast("int").alias("sparse_rank"), F.lit(None).cast("double").alias("sparse_score"))
    s = sparse.select("query", "doc", F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score"), F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.unionByName(s).groupBy("query", "doc").agg(*[F.max(c).alias(c) for c in ("dense_rank", "dense_score", "sparse_rank", "sparse_score")])


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, limit: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion; ties by dense rank, sparse rank and the id as text."""
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = _channels(dense, sparse).withColumn("score", F.round(part("dense_rank", weights[0]) + part("sparse_rank", weights[1]), 9))
    return top_k(fused, limit, F.desc("score"), F.coalesce("dense_rank", F.lit(FAR)), F.coalesce("sparse_rank", F.lit(FAR)), F.col("doc").cast("string"))


def union_stage(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both lists ordered by the sum of ranks; ties as first seen, dense before sparse."""
    both = _channels(dense, sparse).withColumn("total", F.coalesce("dense_rank", F.lit(0)) + F.coalesce("sparse_rank", F.lit(0)))
    return top_k(both, 1 << 30, F.asc("total"), F.coalesce("dense_rank", F.lit(FAR)), F.coalesce("sparse_rank", F.lit(FAR))).withColumn("score", -F.col("total").cast("double"))


def search_stage(mode: str, dense: DataFrame, sparse: DataFrame, k: int, limit: int) -> DataFrame:
    """The list of one search mode."""
    if mode == "hybrid":
        return rrf(dense, sparse, k, limit)
    return (dense if mode == "dense" else sparse).where(F.col("rank") <= limit)


def margin(hits: DataFrame) -> DataFrame:
    """(query, top_score, gap): the best score and its distance to the second; null gap with one hit."""
    first, second = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (1, 2))
    return hits.groupBy("query").agg(first.alias("top_score"), F.round(first - second, 6).alias("gap"))


def ranking_grid(dense: DataFrame, sparse: DataFrame, candidates: list[int], rrf_ks: list[int], limit: int) -> DataFrame:
    """Fused lists for each (candidate_k, rrf_k) of a grid, from lists ranked once at the greatest depth."""
    spark = dense.sparkSession
    grid = spark.createDataFrame([(c, k) for c in candidates for k in rrf_ks], "candidate_k int, rrf_k int")
    both = _channels(dense, sparse).crossJoin(F.broadcast(grid))
    keep = lambda r: F.when(F.col(r) <= F.col("candidate_k"), F.col(r))
    both = both.withColumn("dense_rank", keep("dense_rank")).withColumn("sparse_rank", keep("sparse_rank")).where("dense_rank is not null or sparse_rank is not null")
    part = lambda r: F.coalesce(1.0 / (F.col("rrf_k") + F.col(r)), F.lit(0.0))
    fused = both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9)).withColumn("run", F.struct("candidate_k", "rrf_k", "query"))
    return top_k(fused, limit, F.desc("score"), F.coalesce("dense_rank", F.lit(FAR)), F.coalesce("sparse_rank", F.lit(FAR)), F.col("doc").cast("string"), by="run").drop("run")


#: Scorers by name: functions of (query text, document text) columns.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(name: str):
    def add(f):
        SCORERS[name] = f
        return f

    return add


@scorer("lexical")
def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has: an offline stand-in, not a model."""
    q, t = F.array_distinct(analyze(query)), F.array_distinct(analyze(text))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, top: int, name: str = "lexical", max_chars: int | None = None) -> DataFrame:
    """Hits (with text looked up in ``docs`` (doc, text) and ``queries`` (query, query_text)) in the order of a scorer.

    Earlier scores stay, ``pre_rank`` is the rank before. ``none`` or a scorer that gives null leaves the
    order as it was. The scorer gets whole texts; ``max_chars`` is for one that takes no more characters.
    """
    # the hits of a small table of queries go to the documents, whose texts stay where they are
    with_text = docs.join(maybe_broadcast(hits, queries), "doc").join(maybe_broadcast(queries, queries), "query")
    given = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    score = F.lit(None).cast("double") if name == "none" else SCORERS[name](F.col("query_text"), given)
    scored = with_text.withColumn("rerank_score", F.round(score, 6)).withColumnRenamed("rank", "pre_rank").drop("text", "query_text")
    return top_k(scored, top, F.desc_nulls_last("rerank_score"), F.asc("pre_rank"))


def display_score(mode: str) -> Column:
    """rerank_score if there, else the mode's score, to six places."""
    own = {"hybrid": "score", "dense": "dense_score", "sparse": "sparse_score"}[mode]
    return F.round(F.coalesce("rerank_score", own), 6)
