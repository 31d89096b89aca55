"""Quality of documents by histogram gradient-boosted trees over statistics of the text.

The executors turn each text into NAMES, 37 numbers: lengths, shares of kinds of characters, how words begin,
end and repeat, lines and sentences. The trees are grown in numpy on the driver: numbers are binned at quantiles of the
sample, and every level of a tree takes the best split of each of its nodes from histograms of first and second
derivatives of the logistic loss. All trees are complete to DEPTH levels and kept in three arrays (feature, threshold,
leaf), so that prediction steps through all trees of all rows of a batch at once: node = 2 * node + 1 + (x > threshold).

Learnt from are the doc_ids in usable rows of both tables, EACH of either label at most (those of the least hash of
doc_id), each label weighing as it does among all labelled documents; the statistics of at most 2 * EACH texts come to
the driver. One statistic a doc_id is learnt, the least of the rows that share it; of labels that disagree, the least
counts. Labels of other documents and null labels make no difference. Prediction covers every row and its whole text, of
any length; null and empty texts have statistics of zero. A null doc_id is never learnt from and never held out. Without
labelled documents every score is 0.5, with documents of a single label each is the share (n1 + 1) / (n + 2). Repeated rows
are scored one by one; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._cluster import Scratch, release, tidy

EACH, TREES, DEPTH, BINS, RATE, RIDGE = 4000, 120, 4, 64, 0.15, 1.0
#: Texts whose byte histograms are held at a time.
ROWS = 2048

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "blank": [9, 11, 12, 13, 32], "newline": [10], "digit": range(48, 58), "upper": range(65, 91), "lower": range(97, 123), "beyond_ascii": range(128, 256),
    "full_stop": b".", "comma": b",", "shout": b"!?", "quote": b"\"'", "clause": b";:", "dash": b"-_", "bracket": b"()[]{}<>", "bar": b"|/\\", "sign": b"#$%&*+=@^~`", "control": [*range(9), *range(14, 32), 127],
}
_KIND = np.stack([B.table(k) for k in KINDS.values()], 1).astype(np.float64)
_LOWER, _UPPER, _MARK, _STOP = (B.table(x) for x in ([*range(97, 123), *range(128, 256)], range(65, 91), [k for k in range(33, 127) if not chr(k).isalnum()], b".!?"))
NAMES = (
    "bytes", "words", *(f"{k}_share" for k in KINDS), "byte_entropy", "word_mean", "word_spread", "word_longest", "distinct", "top_share", "word_entropy", "same_as_before", "distinct_pairs",
    "all_upper", "capital", "marked_end", "stop_end", "marked_begin", "no_letters", "single_letter", "long_word", "line_words", "sentence_words",
)


def _entropy(count: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bits of the distribution of each owner's counts."""
    total = np.bincount(owner, count, n)
    return np.log2(np.maximum(total, 1)) - np.bincount(owner, count * np.log2(np.maximum(count, 1)), n) / np.maximum(total, 1)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, occurrences) of each distinct key of an owner."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(k) else np.zeros(0, np.int64)
    return o[new], np.diff(np.concatenate([new, [len(k)]]))


def statistics(column: pa.Array) -> np.ndarray:
    """NAMES of each text of a column."""
    out = [np.zeros((0, len(NAMES)))]
    for a in range(0, len(column), ROWS):
        for _, raw, starts, ends, hashes, rows, own in B.batch_spans(column.slice(a, ROWS), B.SPACE):
            out.append(_statistics(raw, starts, ends, hashes, rows, own))
    return np.concatenate(out)


def _statistics(raw, starts, ends, hashes, rows, own) -> np.ndarray:
    n, lens, words = len(own) - 1, np.diff(own), np.diff(rows)
    hist = np.bincount(np.repeat(np.arange(n) * 256, lens) + raw, minlength=n * 256).reshape(n, 256)
    size, many = np.maximum(lens, 1), np.maximum(words, 1)
    shares = hist @ _KIND
    byte = np.log2(size) - (hist * np.log2(np.maximum(hist, 1))).sum(1) / size
    owner, long = np.repeat(np.arange(n), words), (ends - starts).astype(np.float64)
    per = lambda x: np.bincount(owner, x, n) / many
    mean = per(long)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, long)
    who, count = _repeats(hashes, owner)
    top = np.zeros(n)
    np.maximum.at(top, who, count)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    mates = _repeats(B.mix(hashes[pair] * B._STEP[1] + hashes[pair + 1]), owner[pair])[0]
    same = np.bincount(owner[pair], hashes[pair] == hashes[pair + 1], n)
    low, up = (np.concatenate([[0], np.cumsum(t[raw], dtype=np.int32)]) for t in (_LOWER, _UPPER))
    lows, ups = low[ends] - low[starts], up[ends] - up[starts]
    head, tail = raw[starts], raw[ends - 1]
    stops = np.bincount(owner, _STOP[tail], n)
    return np.column_stack([
        np.log1p(lens), np.log1p(words), shares / size[:, None], byte, mean, np.sqrt(np.maximum(0, per(long**2) - mean**2)), np.log1p(longest),
        np.bincount(who, minlength=n) / many, top / many, _entropy(count, who, n), same / many, np.bincount(mates, minlength=n) / many,
        per((lows == 0) & (ups > 1)), per(_UPPER[head]), per(_MARK[tail]), stops / many, per(_MARK[head]), per(lows + ups == 0), per(long == 1), per(long > 12),
        words / (hist[:, 10] + 1), words / (stops + 1),
    ])


class Trees:
    """Boosted trees of one depth as arrays: feature and threshold of every inner node, the value of every leaf."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.leaf = np.zeros((0, (1 << DEPTH) - 1), np.int32), np.zeros((0, (1 << DEPTH) - 1)), np.zeros((0, 1 << DEPTH))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of statistics."""
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        tree, row = np.arange(len(self.leaf))[None], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - ((1 << DEPTH) - 1)].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each feature: between neighbouring values, at quantiles where there are more values than bins."""
    out = []
    for f in x.T:
        v = np.unique(f)
        if len(v) > bins:
            v = np.unique(np.quantile(f, np.linspace(0, 1, bins), method="nearest"))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Trees that fit labels y (0 or 1) of rows x."""
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model, limits = Trees(float(np.log(share / (1 - share)))), cuts(x)
    bins = np.column_stack([np.searchsorted(c, f, "left") for c, f in zip(limits, x.T, strict=True)]).astype(np.int64)
    n, width = x.shape
    column, margin, last = np.arange(width) * BINS, np.full(n, model.base), (1 << DEPTH) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(last, np.int32), np.full(last, np.inf), np.zeros(n, np.int64)
        split = False
        for level in range(DEPTH):
            first, size = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * width * BINS + column + bins).ravel()
            left_g, left_h = (np.bincount(slot, np.repeat(v, width), size * width * BINS).reshape(size, width, BINS).cumsum(2) for v in (g, h))
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < RIDGE) | (right_h < RIDGE)] = 0
            best = gain.reshape(size, -1).argmax(1)
            f, b = best // BINS, best % BINS
            for k in np.flatnonzero(gain.reshape(size, -1).max(1) > 1e-6):
                feature[first + k], threshold[first + k], split = f[k], limits[f[k]][b[k]], True
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - last
        leaf = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + RIDGE)
        if not split:
            break
        margin = margin + leaf[at]
        model.feature, model.threshold, model.leaf = (np.concatenate([a, b[None]]) for a, b in ((model.feature, feature), (model.threshold, threshold), (model.leaf, leaf)))
    return model


def _described(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, each: int = EACH):
    """The broadcast trees, or the score of all texts where there are not both labels. usable is a condition on doc_id."""
    spark = docs.sparkSession
    s = Scratch(spark, "quality")
    told = labels.where(usable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = s.table(told.join(docs.where(usable).select("doc_id"), "doc_id", "left_semi"))
    hash_of = F.xxhash64("doc_id")
    picked, total = [], {}
    for label in (0, 1):
        mine = told.where(F.col("quality") == label).select("doc_id")
        total[label] = mine.count()
        picked.append(mine.orderBy(hash_of, "doc_id").limit(each).withColumn("y", F.lit(label)))
    if not (total[0] and total[1]):
        return (total[1] + 1) / (sum(total.values()) + 2)
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * each numbers
    texts = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").cast("long"), "text")
    found = texts.mapInArrow(tidy(_described), "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    table = found.join(chosen, "doc_id").orderBy("doc_id").toArrow()  # 2 * each rows of NAMES numbers
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y = table["y"].to_numpy().astype(np.float64)
    stands = np.array([total[0] / max(1, (y == 0).sum()), total[1] / max(1, (y == 1).sum())])
    weight = stands[y.astype(int)]
    model = grow(x, y, weight / weight.mean())
    del table, found, x
    release()
    s.keep()
    return spark.sparkContext.broadcast(model)


def held_out() -> Column:
    """The fold whose labels are never read: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _score(model):
    def run(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            score = [model.value.scores(x[a : a + ROWS]) for a in range(0, len(x), ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    model = train(docs, labels, F.col("doc_id").isNotNull() & ~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(model, float):
        return rows.select("doc_id", F.lit(model).alias("score"))
    return rows.mapInArrow(tidy(_score(model)), "doc_id long, score double")
