"""Two ranked lists as one: reciprocal rank fusion, and a second ranking by resolution and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import patterns as P


def fused(lexical: DataFrame, dense: DataFrame, k: int = P.RRF_K) -> DataFrame:
    """(qid, id, bm25_rank, dense_rank, rrf) of two lists (qid, id, rank), ranks from 0 and null where a list lacks the document."""
    both = lexical.select("qid", "id", F.col("rank").alias("bm25_rank")).join(dense.select("qid", "id", F.col("rank").alias("dense_rank")), ["qid", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", part("bm25_rank") + part("dense_rank"))


def reranked(found: DataFrame, facts: DataFrame, top_n: int = P.TOP_N, top_k: int = P.TOP_K) -> DataFrame:
    """(qid, id, rrf, final, rank from 1): of each query's top_n by rrf the top_k by 1000 * rrf + 0.35 * min(res_score, 6) + 0.25 * recency; facts(id, res_score, recency) may lack documents."""
    first = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), "id")
    short = found.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= top_n).drop("_k")
    score = F.col("rrf") * 1000 + 0.35 * F.least(F.coalesce("res_score", F.lit(0)), F.lit(6)) + 0.25 * F.coalesce("recency", F.lit(0.5))
    second = Window.partitionBy("qid").orderBy(F.round("final", 9).desc(), "id")
    return short.join(facts, "id", "left").withColumn("final", score).withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= top_k).select("qid", "id", "rrf", "final", "rank")
