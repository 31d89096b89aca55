"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text and their beginnings (4 to 8 bytes, A-Z lower case), each hashed to one of
2 ** BITS buckets and counted by level of occurrence; a feature weighs by how few texts have it, a text by the root of
how many features it has. It is trained in numpy on the driver from confirmed toxic texts and unlabelled ones alone,
on all features that two of these texts or more have: with prior p of toxic text, the risk is
p * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - p * E_toxic[loss(-)]), and where the second part turns negative
its gradient is reversed, so that a flexible model can't overfit the confirmed texts. An L1 step keeps weights sparse.

At most TOXIC confirmed and UNLABELLED unlabelled texts are used, those of the least hash of doc_id and one for each
doc_id (the least of those that share it), with IDS features in all (the longest texts of the sample are left out beyond
that); the features are hashed on the executors. Labels count only for doc_ids that the documents hold, so those of other
documents change neither sample nor prior. The prior is the share of toxic ones among the labelled documents: whoever
labels by another rule than by chance should know that it is taken for that of all texts. Scoring covers every row and
the whole of its text, of any length. Labels of doc_ids in the held-out fold are never read. Null and empty texts have
no features and score by the intercept. A null doc_id is never labelled and never held out. Without any confirmed
toxic text among the documents, or without any other text, every score is 0, with a warning where labels confirm none. Rows
that repeat a doc_id are scored one by one; of labels that disagree, toxic wins. An empty table gives an empty result;
further columns are ignored by scores() and kept by keep_civil(), whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._cluster import Scratch, plain, release, tidy

TOXIC, UNLABELLED, BITS = 1000, 3000, 18
#: Features of the texts learnt from, together; the longest texts are left out of the sample beyond.
IDS = 24_000_000
#: How strongly the reversed gradient counts; the texts whose features are unpacked at a time.
BACK, BLOCK = 0.1, 250
#: Occurrences in a text from which a feature counts anew.
LEVELS = (1, 2, 4)
BEGINNINGS = (4, 5, 6, 7, 8)
#: What separates words: all of ASCII but letters and digits.
_APART = B.NOT_ALNUM.copy()
_APART[65:91] = False


def features(column: pa.Array):
    """(row, feature hashes, with repeats) for each text of a column."""
    for first, raw, starts, ends, hashes, rows, own in B.batch_spans(column, _APART):
        every = [hashes]
        lower = B.LOWER[raw]
        for k in BEGINNINGS:
            cut = np.minimum(ends, starts + k)
            code = np.zeros(len(starts), np.uint64)
            for j in range(k):
                byte = lower[np.minimum(starts + j, max(0, len(lower) - 1))].astype(np.uint64) if len(lower) else code
                code |= np.where(starts + j < cut, byte, np.uint64(0)) << np.uint64(8 * j)
            every.append(B.mix(code * B._STEP[40 + k] + np.uint64(k)))
        table = np.stack(every, 1) if len(hashes) else np.zeros((0, 1), np.uint64)
        for k in range(len(rows) - 1):
            yield first + k, table[rows[k] : rows[k + 1]].ravel()


def ids(found: np.ndarray) -> np.ndarray:
    """The distinct features of a text: LEVELS ids a bucket, for one occurrence and for more."""
    at, n = np.unique((found >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    return np.concatenate([at[n >= least] * len(LEVELS) + k for k, least in enumerate(LEVELS)])


def _extract(batches):
    """(doc_id, toxic, features) of sampled texts."""
    for batch in batches:
        out = [ids(f) for _, f in features(batch.column(2))]
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(flat))], ["doc_id", "toxic", "found"])


def fit(rows: list[np.ndarray], sure: np.ndarray, prior: float, rounds: int = 100, rate: float = 0.1, l1: float = 0.15) -> tuple[np.ndarray, float]:
    """The weights of all features and the intercept of the model of least non-negative PU risk; sure marks the confirmed texts, l1 is shared by the texts."""
    size, n = len(LEVELS) << BITS, len(rows)
    df = sum((np.bincount(np.concatenate(rows[a : a + BLOCK]), minlength=size) for a in range(0, n, BLOCK)), np.zeros(size, np.int64))
    names = np.flatnonzero(df >= 2)
    rare = np.log((n + 1) / (df[names] + 1))
    slot = np.full(size, -1, np.int32)
    slot[names] = np.arange(len(names), dtype=np.int32)
    scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    blocks = []
    for a in range(0, n, BLOCK):
        known = [slot[r] for r in rows[a : a + BLOCK]]
        known = [r[r >= 0] for r in known]
        blocks.append((slice(a, min(a + BLOCK, n)), np.concatenate(known), np.array([len(r) for r in known])))
    n_p, n_u = max(1, sure.sum()), max(1, (~sure).sum())
    w, b = np.zeros(len(names)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        weight, z = w * rare, np.zeros(n)
        for part, at, lens in blocks:
            total = np.concatenate([[0.0], np.cumsum(weight[at])])
            end = np.cumsum(lens)
            z[part] = total[end] - total[end - lens]
        z = z * scale + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_no = np.logaddexp(0, z)
        clean = loss_no[~sure].mean() - prior * loss_no[sure].mean()
        g = np.where(sure, -prior * p / n_p, p / n_u)  # of the part for clean text
        g = np.where(sure, prior * (p - 1) / n_p, 0) + g if clean >= 0 else -BACK * g
        gw, gb = np.zeros_like(w), g.sum()
        for part, at, lens in blocks:
            gw += np.bincount(at, np.repeat(g[part] * scale[part], lens), len(names))
        gw *= rare
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 - 0.9**k)
        spread = np.sqrt(v / (1 - 0.999**k)) + 1e-7
        w -= step * m / spread
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 / n / spread, 0)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**k)) + 1e-7)
    out = np.zeros(size, np.float32)
    out[names] = w * rare
    return out, float(b)


def _score(model):
    def run(batches):
        w, b = model.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for k, f in features(batch.column(1)):
                own = ids(f)
                z[k] = w[own].sum(dtype=np.float64) / np.sqrt(max(1, len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z + b, -40, 40))))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, toxic: int = TOXIC, unlabelled: int = UNLABELLED, most_ids: int = IDS):
    """The broadcast model, or None without a confirmed toxic text among docs. usable is a condition on doc_id."""
    spark = docs.sparkSession
    s = Scratch(spark, "toxicity")
    ids = s.table(docs.where(usable).select("doc_id").distinct())
    told = s.table(labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(ids, "doc_id", "left_semi"))
    share = told.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    if not share:
        warnings.warn("no label marks a document of the table as toxic; nothing is learnt", stacklevel=2)
        return None
    by = F.xxhash64("doc_id")
    sure = told.where("toxic = 1").select("doc_id").orderBy(by, "doc_id").limit(toxic).withColumn("toxic", F.lit(1))
    rest = ids.orderBy(by, "doc_id").limit(unlabelled).withColumn("toxic", F.lit(0))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sure.unionByName(rest)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = s.table(chosen.mapInArrow(tidy(_extract), "doc_id long, toxic int, found array<int>"))
    sizes = sample.select("doc_id", "toxic", F.size("found").alias("n")).toPandas().sort_values(["n", "doc_id", "toxic"], ignore_index=True)  # as many rows as the sample
    longest = int(sizes["n"][sizes["n"].cumsum() <= most_ids].max()) if (sizes["n"].cumsum() <= most_ids).any() else 0
    found = sample.where(F.size("found") <= longest).orderBy(by, "doc_id", "toxic").select("toxic", "found").toArrow()
    marks, lists = found["toxic"].to_numpy(zero_copy_only=False) == 1, found["found"].combine_chunks()
    if not marks.any() or marks.all():
        return None
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    rows = [flat[b - n : b] for b, n in zip(end, np.diff(np.concatenate([[0], end])), strict=True)]
    model = fit(rows, marks, min(max(share, 1e-4), 0.9))
    del found, lists, flat, rows
    release()
    s.keep()
    return spark.sparkContext.broadcast(model)


def held_out() -> Column:
    """The fold whose labels are never read: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    model = train(docs, labels, F.col("doc_id").isNotNull() & ~held_out())
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_score(model)), "doc_id long, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold."""
    model = train(docs, labels, F.col("doc_id").isNotNull() & ~held_out())
    if model is None:
        return docs
    at = docs.columns.index("text")

    def civil(batches):
        for batch in batches:
            score = next(_score(model)([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])])).column(1).to_numpy()
            yield batch.filter(pa.array(score < threshold))

    return plain(docs).mapInArrow(tidy(civil), docs.schema)
