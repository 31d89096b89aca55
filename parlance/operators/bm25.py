"""A stored BM25 index: postings by shard of documents, in blocks, searched with skipping.

Each task of the scan inverts its documents in place, some SHARD of them or tfidf.CHUNK bytes of text at a time: a shard. For each
term a shard holds its postings, ordered by id, in blocks of BLOCK: ids, occurrences and lengths. They are written once and nothing
but the counts of terms is shuffled; impacts, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)), follow when postings are read. A search sends the
terms of a block of queries to all shards and shuffles only the postings of these terms, by shard; so a frequent term is one
key in every shard, never one task. Within a shard a query takes its terms by falling upper bound (weight times largest
impact); once what the remaining terms could add is less than the k-th best sum so far, documents that only they hold can't
be among the k best, and of their blocks only those are read in which a document still in the running may lie.

Queries of the index are exact: the k best of each shard are those of the exhaustive sum, and the k best of all follow.
Weights can be negative only where the mean idf is; such queries are summed in full. Null texts and texts without terms
are no documents of the index; rows that share an id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.dialect import SPARK
from parlance.operators import tfidf
from parlance.operators.tables import cut, once, written
from parlance.session import ship

K1, B, EPSILON = 1.5, 0.75, 0.25
SHARD, BLOCK = 20_000, 128
#: Terms of queries that are sent at a time.
TERMS = 500_000
SCORES = "qid long, id long, score double"


def _documents(docs: DataFrame) -> DataFrame:
    """(id, terms) of docs(id, text), one row for each id."""
    rows = docs.toDF("id", "text").where("id is not null").select(F.col("id").cast("long").alias("id"), F.expr(T.terms(SPARK, "text")).alias("terms")).where("size(terms) > 0")
    twice = cut(docs.toDF("id", "text").groupBy(F.col("id").cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():
        return rows
    again = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return rows.join(twice, "id", "left_anti").unionByName(again)


def _inverted(batches):
    """The postings of a task's documents (id, words joined by blanks), a shard at a time."""
    part, held, size, k = [], 0, 0, 0
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a in range(0, batch.num_rows, SHARD):
            part.append(batch.slice(a, SHARD))
            held, size = held + part[-1].num_rows, size + part[-1].nbytes
            if held >= SHARD or size >= tfidf.CHUNK:
                yield from _shard(first + k, pa.Table.from_batches(part))
                part, held, size, k = [], 0, 0, k + 1
    if held:
        yield from _shard(first + k, pa.Table.from_batches(part))


def _shard(number: int, table: pa.Table):
    chunk = tfidf.Chunk(table)
    terms, parts = chunk.term()
    length = np.bincount(chunk.doc, minlength=len(chunk.ids)).astype(np.int32)
    for doc, code, tf in parts:
        order = np.argsort(code, kind="stable")
        doc, code, tf = doc[order], code[order], tf[order].astype(np.int32)
        at = np.arange(len(code)) - np.searchsorted(code, code)
        start = np.flatnonzero(at % BLOCK == 0)
        ends = pa.array(np.append(start, len(code)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (chunk.ids[doc], tf, length[doc])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), number)), terms.take(pa.array(code[start])), pa.array((at[start] // BLOCK).astype(np.int32)), *lists], ["shard", "term", "block", "ids", "tfs", "lengths"])


def _base(docs: DataFrame) -> dict:
    """What is written of an index: inverted (shard, term, block, ids, tfs, lengths) and terms (term, df, idf); n, the number of documents, and their mean length."""
    ship(docs.sparkSession)
    rows = _documents(docs).select("id", F.array_join("terms", " ").alias("words"))
    inverted = written(rows.mapInArrow(_inverted, "shard long, term string, block int, ids array<long>, tfs array<int>, lengths array<int>"), "inverted")
    n = docs.toDF("id", "text").where(F.col("id").isNotNull() & F.lower("text").rlike("[a-z0-9]")).select(F.col("id").cast("long")).distinct().count()
    mean = (inverted.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("s")).first()["s"] or 0) / max(1, n) or 1.0
    df = inverted.groupBy("term").agg(F.sum(F.size("ids")).cast("double").alias("df"))
    raw = written(df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    usual = raw.agg(F.avg("raw").alias("m")).first()["m"] or 0.0
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * usual)).otherwise(F.col("raw")).alias("idf"))
    return {"inverted": inverted, "terms": terms, "n": n, "mean": mean}


def _views(base: dict) -> dict:
    """With postings and counts (id, term, tf), made from inverted when they are read."""
    tf, length = F.col("tfs"), F.col("lengths")
    impacts = F.zip_with(tf, length, lambda t, n: t * (K1 + 1) / (t + K1 * (1 - B + B * n / F.lit(base["mean"]))))
    postings = base["inverted"].select("shard", "term", "block", "ids", impacts.alias("impacts")).withColumn("top", F.array_max("impacts"))
    counts = base["inverted"].select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select(F.col("p.ids").alias("id"), "term", F.col("p.tfs").cast("long").alias("tf"))
    return base | {"postings": postings, "counts": counts}


def build(docs: DataFrame) -> dict:
    """postings, terms (term, df, idf) and counts (id, term, tf) of docs(id, text), with n, the number of documents."""
    return _views(_base(docs))


def index(docs: DataFrame, key: tuple) -> dict:
    """The index of docs(id, text), built by the first query of this application that asks for it by this key."""
    return _views(once(docs.sparkSession, ("bm25", *key), lambda: _base(docs)))


def weights(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, term, weight): idf times occurrences of each term of queries(qid, text) that the index knows."""
    rows = queries.toDF("qid", "text").where("qid is not null").select(F.col("qid").cast("long").alias("qid"), F.explode(F.expr(T.terms(SPARK, "text"))).alias("term"))
    return rows.groupBy("qid", "term").agg(F.count("*").alias("q")).join(terms, "term").select("qid", "term", (F.col("q") * F.col("idf")).alias("weight"))


class Shard:
    """The postings of some terms in one shard, their documents numbered."""

    def __init__(self, terms: list, blocks: list, ids: list, impacts: list):
        order = sorted(range(len(terms)), key=lambda k: (terms[k], blocks[k]))
        self.docs = np.unique(np.concatenate([ids[k] for k in order])) if order else np.zeros(0, np.int64)
        self.lists: dict[str, list[tuple[np.ndarray, np.ndarray, float]]] = {}
        for k in order:
            at = np.searchsorted(self.docs, ids[k])
            self.lists.setdefault(terms[k], []).append((at, impacts[k], float(impacts[k].max())))
        self.read = 0

    def top(self, query: list[tuple[str, float]], k: int, skip: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the shard's documents that hold a term of the query, ties included."""
        known = [(w, self.lists[t]) for t, w in query if t in self.lists]
        score, met = np.zeros(len(self.docs)), np.zeros(len(self.docs), bool)
        skip = skip and all(w >= 0 for w, _ in known)
        bound = lambda x: x[0] * max(b[2] for b in x[1])
        known.sort(key=bound, reverse=True)
        rest = np.append(np.cumsum([bound(x) for x in known][::-1])[::-1], 0.0)  # what the terms from here on can add
        running = None  # documents that may still be among the k best, once no other can
        for j, (w, blocks) in enumerate(known):
            if skip and running is None and j and np.count_nonzero(met) >= k:
                floor = np.partition(score, len(score) - k)[-k]
                if rest[j] < floor * (1 - 1e-12) - 1e-9:
                    running = np.flatnonzero(score + rest[j] >= floor - 1e-9)
            elif running is not None:
                floor = np.partition(score[running], len(running) - k)[-k]
                running = running[score[running] + rest[j] >= floor - 1e-9]
            for at, impact, _ in blocks:
                if running is not None:
                    a, b = np.searchsorted(running, (at[0], at[-1] + 1))
                    if a == b:
                        continue
                self.read += len(at)
                score[at] += w * impact
                met[at] = True
        own = np.flatnonzero(met) if running is None else running[met[running]]
        if len(own) > k:
            seen = np.round(score[own], 9)
            own = own[seen >= np.partition(seen, len(own) - k)[-k]]
        return self.docs[own], score[own]


def _search(k: int, sent):
    def run(key, table):
        arrays = lambda name: [np.asarray(x.values) for x in table.column(name)]
        shard = Shard(table.column("term").to_pylist(), table.column("block").to_pylist(), arrays("ids"), arrays("impacts"))
        qid, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q, terms in sent.value.items():
            found, score = shard.top(terms, k)
            order = np.lexsort((found, -np.round(score, 9)))[:k]
            qid.append(np.full(len(order), q))
            ids.append(found[order])
            scores.append(score[order])
        return pa.table({"qid": np.concatenate(qid), "id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def _every(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        arrays = lambda name: [np.asarray(x.values) for x in table.column(name)]
        shard = Shard(table.column("term").to_pylist(), table.column("block").to_pylist(), arrays("ids"), arrays("impacts"))
        for q, terms in sent.value.items():
            found, score = shard.top(terms, len(shard.docs), skip=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(score)], ["qid", "id", "score"])

    return run


def _sent(stored: dict, queries: DataFrame):
    """Block by block of queries(qid, text): their weights by query, broadcast, and the postings of their terms."""
    spark = queries.sparkSession
    ship(spark)
    wanted = cut(weights(queries, stored["terms"]))
    blocks = max(1, -(-wanted.count() // TERMS))
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        asked: dict[int, list] = {}
        for r in mine.orderBy("qid", "term").toLocalIterator():  # some TERMS rows
            asked.setdefault(r["qid"], []).append((r["term"], r["weight"]))
        if asked:
            terms = F.broadcast(mine.select("term").distinct())
            yield spark.sparkContext.broadcast(asked), stored["postings"].drop("top").join(terms, "term", "left_semi").groupBy("shard")


def search(stored: dict, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best documents for each of queries(qid, text), rank from 0; ties to nine places go to the smaller id."""
    every = queries.sparkSession.createDataFrame([], SCORES)
    for sent, shards in _sent(stored, queries):
        every = every.unionByName(cut(shards.applyInArrow(_search(k, sent), SCORES)))
        sent.unpersist()
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return every.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def scores(stored: dict, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of every document that shares a term with a query. A document lies in one shard, which sums its scores, so pairs are not shuffled."""
    every = queries.sparkSession.createDataFrame([], SCORES)
    for sent, shards in _sent(stored, queries):
        every = every.unionByName(shards.applyInArrow(_every(sent), SCORES))
    return every
