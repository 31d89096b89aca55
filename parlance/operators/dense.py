"""Exact dense retrieval: blocks of queries against all vectors, the k best of each part kept before anything is shuffled.

Vectors that are null or hold null or non-finite entries take no part, nor do those of another length than the most frequent
one of the corpus (the least of several); zero vectors do. The work is queries times vectors: it suits a set of queries that
does not grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.tables import cut
from parlance.session import ship

#: Queries that are sent at a time, and rows compared with them at a time.
BLOCK, TILE = 4096, 2048


def finite(vector: str) -> Column:
    """Whether a vector has entries and all are numbers."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, in no order: by score to nine places, then by id."""
    if scores.shape[1] <= k:
        return ids, scores
    seen = np.round(scores, 9)
    least = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k, None]
    take = seen >= least
    for r in np.flatnonzero(take.sum(1) > k):  # ties at the end
        take[r] = False
        take[r, np.lexsort((ids[r], -seen[r]))[:k]] = True
    at = np.nonzero(take)[1].reshape(-1, k)
    return np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)


def _best(k: int, d: int, sent):
    def run(batches):
        asked, q = sent.value
        ids, scores = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                names = np.broadcast_to(part.column(0).to_numpy(), (len(asked), part.num_rows))
                new = np.nan_to_num(q @ _vectors(part.column(1), d).T, nan=-np.inf)  # infinities of both signs
                ids, scores = _merge(np.concatenate([ids, names], 1), np.concatenate([scores, new], 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], ["qid", "id", "score"])

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k rows of corpus (id, vector) of the largest inner product with each of queries (qid, vector), rank from 0; ties to nine places go to the smaller id."""
    spark = corpus.sparkSession
    ship(spark)
    corpus = corpus.toDF("id", "e").select(F.col("id").cast("long").alias("id"), "e").where(F.col("id").isNotNull() & finite("e"))
    queries = queries.toDF("qid", "e").select(F.col("qid").cast("long").alias("qid"), "e").where(F.col("qid").isNotNull() & finite("e"))
    every = spark.createDataFrame([], "qid long, id long, score double")
    length = corpus.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is not None:
        d = length["d"]
        corpus, queries = corpus.where(F.size("e") == d), queries.where(F.size("e") == d)
        blocks = max(1, -(-queries.count() // BLOCK))
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow().combine_chunks()
            if rows.num_rows:
                sent = spark.sparkContext.broadcast((rows["qid"].to_numpy(), _vectors(rows["e"].combine_chunks(), d)))
                every = every.unionByName(cut(corpus.mapInArrow(_best(k, d, sent), "qid long, id long, score double")))
                sent.unpersist()
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return every.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
