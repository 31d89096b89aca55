"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to cells by their nearest centroid; centroids come from k-means on a sample of SAMPLE vectors at most
(those of the least hash of vec_id), some root of the number of rows of them. What is left of a vector without its
centroid is rotated by one random orthogonal matrix; the signs of the rotated components are its code, packed eight to
a byte, with two correction scalars: its norm and the inner product of its unit vector with its code's. For a query,
the inner product with a code is an unbiased estimate of that with the rest once divided by the second scalar, and it
errs by at most norm * |query| * sqrt((1 - c*c) / (c*c)) * EPSILON / sqrt(d - 1) but for a small chance. Of the cells
that a query looks into, the candidates whose upper bound reaches the k-th best lower bound are ranked again by the
exact inner product in double precision; the k best of each part of the table are then merged.

A query looks into the cells of the largest inner product with the centroid, allowing for the spread in the cell: into
as many as, on the sample, hold COVER of the true neighbours of TRIED vectors, and at least as many as hold LEAST * k
vectors. Cells are not capped. Queries that found fewer than k are searched again in all cells, and `probes` sets the
number of cells, up to all of them, for whoever wants no cell left out.

Queries are taken QUERY_BLOCK at a time, so what is broadcast has a fixed size. Rows are written in order of cell (a
large cell in several parts), so a task meets the queries of its own cells, a batch at a time, and holds k results for
each of them.

Vectors that are null, zero, of another length than the most frequent one or with null or non-finite components take
no part; components of any finite size do. Rows that repeat a vec_id are separate candidates. The rows that share a
query's vec_id are its own and no candidates; if their vectors differ, the least in array order asks. Ties go to the
smaller vec_id. With k or fewer candidates all are returned, an empty table gives an empty result. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._cluster import Scratch, tidy

QUERY_BLOCK, EPSILON, SEED = 8192, 3.0, 11
SAMPLE, CELLS, ROUNDS, TRIED, COVER, LEAST = 20_000, 4096, 8, 400, 0.95, 10
#: Rows of a cell compared with its queries at a time, and queries at a time, which bound the table of estimates.
TILE = 512


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64) if len(column) else np.zeros((0, d))


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, also where squares would overflow."""
    top = np.maximum(np.abs(x).max(1, initial=0), 1e-300)
    return top * np.linalg.norm(x / top[:, None], axis=1)


class Cells:
    """Centroids, the spread about them, and in how many cells a query looks."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = SEED):
        r = np.random.Generator(np.random.PCG64(seed))
        self.unit = max(float(np.abs(sample).max()), 1e-300)  # the k-means runs on numbers of moderate size
        x = sample / self.unit
        n = int(max(1, min(CELLS, round(rows**0.5), len(x) // 16)))
        self.centre = x[r.choice(len(x), n, replace=False)]
        for _ in range(ROUNDS):
            own = self._nearest(x)
            count = np.bincount(own, minlength=n)
            total = np.zeros_like(self.centre)
            np.add.at(total, own, x)
            self.centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.centre)
        own = self._nearest(x)
        away = ((x - self.centre[own]) ** 2).sum(1)
        mean = away.mean()
        count = np.bincount(own, minlength=n)
        self.spread = np.sqrt((np.bincount(own, away, n) + mean) / (count + 1) / x.shape[1])
        tried = x[r.choice(len(x), min(TRIED, len(x)), replace=False)]
        order = self.order(tried * self.unit)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[None].repeat(len(order), 0), 1)
        score = tried @ x.T
        near = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, : k + 1]  # itself included
        ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        self.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(COVER * len(ranks))) - 1)]) + 1

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        half = (self.centre**2).sum(1) / 2
        return np.concatenate([(x[a : a + 4096] @ self.centre.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return self._nearest(x / self.unit)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All cells for each query, the most promising first."""
        turn = (q / self.unit) / np.maximum(_norms(q) / self.unit, 1e-300)[:, None]
        return np.argsort(-(turn @ self.centre.T + 3 * self.spread), axis=1, kind="stable")


def _index(d: int, sent):
    def run(batches):
        p, cells = rotation(d), sent.value
        for batch in batches:
            x = _vectors(batch.column(1), d)
            cell = cells.nearest(x)
            rest = x - cells.centre[cell] * cells.unit
            norm = _norms(rest)
            turned = (rest / np.maximum(norm, 1e-300)[:, None]) @ p
            fit = np.maximum(np.abs(turned).sum(1) / np.sqrt(d), 1e-9)
            packed = np.packbits(turned >= 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(norm), pa.array(fit)],
                ["cell", "vec_id", "embedding", "code", "norm", "fit"],
            )

    return run


def _search(d: int, k: int, sent_cells, sent_queries):
    def run(batches):
        cells = sent_cells.value
        ids, q, looks, starts = sent_queries.value  # looks[starts[c] : starts[c + 1]] are the queries that look into cell c
        size = _norms(q)
        unit = q / size[:, None]
        turned = (unit @ rotation(d)).astype(np.float32)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a query: ids and scores of its nearest, the best first
        for batch in batches:
            if not batch.num_rows:
                continue
            where, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _vectors(batch.column(2), d)
            packed = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(vec), -1)
            norm, fit = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            order = np.argsort(where, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(where[order])) + 1, [len(order)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                cell = int(where[order[lo]])
                asked = looks[starts[cell] : starts[cell + 1]]
                if not len(asked):
                    continue
                base = (unit[asked] @ cells.centre[cell]) * cells.unit
                for a in range(lo, hi, TILE):
                    rows = order[a : min(a + TILE, hi)]
                    signs = (np.unpackbits(packed[rows], axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
                    scale = norm[rows] / fit[rows]
                    slack = norm[rows] * np.sqrt(np.maximum(0, 1 - fit[rows] ** 2)) / fit[rows] * EPSILON / np.sqrt(max(1, d - 1))
                    slack = slack + 1e-6 * scale  # of single precision
                    for b in range(0, len(asked), TILE):
                        who = asked[b : b + TILE]
                        with np.errstate(all="ignore"):
                            guess = (turned[who] @ signs.T) * scale + base[b : b + TILE, None]
                            low, high = guess - slack, guess + slack
                            floor = np.array([best[int(w)][1][-1] / size[w] if int(w) in best and len(best[int(w)][1]) == k else -np.inf for w in who])
                        own = ids[who, None] == vec[rows]
                        low = np.where(own | np.isnan(low), -np.inf, low)
                        if len(rows) > k:
                            floor = np.maximum(floor, np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k])
                        slip = np.abs(floor) * 1e-12  # of the exact score's rounding
                        hits = ~(high < (floor - np.where(np.isfinite(slip), slip, 0))[:, None]) & ~own
                        for j in np.flatnonzero(hits.any(1)):
                            near, w = rows[hits[j]], int(who[j])
                            with np.errstate(all="ignore"):
                                exact = (x[near] * q[w]).sum(1)
                            names, scores = vec[near], np.where(np.isnan(exact), -np.inf, exact)
                            if w in best:
                                names, scores = np.concatenate([best[w][0], names]), np.concatenate([best[w][1], scores])
                            top = np.lexsort((names, -scores))[:k]
                            best[w] = names[top], scores[top]
        found = sorted(best)
        lens = [len(best[w][0]) for w in found]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(ids[found], lens) if found else np.zeros(0, np.int64)), pa.array(np.concatenate([best[w][0] for w in found]) if found else np.zeros(0, np.int64)),
            pa.array(np.concatenate([best[w][1] for w in found]) if found else np.zeros(0)),
        ], ["query_id", "vec_id", "score"])

    return run


def _looked(cells: Cells, q: np.ndarray, counts: np.ndarray, probes: int | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries that look into each cell, one cell after the other, and where each cell's begin."""
    order = cells.order(q)
    enough = (np.cumsum(counts[order], axis=1) - counts[order] < least).sum(1)  # cells that it takes to see so many vectors
    n = np.minimum(len(counts), np.maximum(cells.probes if probes is None else probes, enough))
    cell = np.concatenate([row[:m] for row, m in zip(order, n, strict=True)])
    who = np.repeat(np.arange(len(q)), n)
    by = np.lexsort((who, cell))
    return who[by], np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(counts)))])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product found for each query row."""
    spark = vectors.sparkSession
    s = Scratch(spark, "rabitq")
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    none = good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return none
    d, rows = lengths["d"], lengths["n"]
    good = good.where(F.size("embedding") == d)
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow()
    cells = Cells(_vectors(drawn["embedding"].combine_chunks(), d), rows, k)
    sent = spark.sparkContext.broadcast(cells)
    kind = good.schema["embedding"].dataType.simpleString()
    codes = good.mapInArrow(tidy(_index(d, sent)), f"cell int, vec_id long, embedding {kind}, code binary, norm double, fit double")
    codes = s.table(codes.repartitionByRange("cell", F.xxhash64("vec_id", "embedding")).sortWithinPartitions("cell"))
    counts = np.zeros(len(cells.centre), np.int64)
    for r in codes.groupBy("cell").agg(F.count("*").alias("n")).collect():  # CELLS rows at most
        counts[r["cell"]] = r["n"]
    asked = s.table(codes.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))

    def search(asked: DataFrame, probes: int | None, least: int) -> DataFrame | None:
        blocks, every = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
            if not part.num_rows:
                continue
            ids, q = part["vec_id"].to_numpy(), _vectors(part["embedding"].combine_chunks(), d)
            queries = spark.sparkContext.broadcast((ids, q, *_looked(cells, q, counts, probes, least)))
            found = s.table(codes.mapInArrow(tidy(_search(d, k, sent, queries)), "query_id long, vec_id long, score double"))
            queries.unpersist()
            every = found if every is None else every.unionByName(found)
        return every

    every = search(asked, probes, LEAST * k)
    if every is None:
        return none
    got = s.table(every.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k))
    short = s.table(asked.join(got.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti"))
    if (again := search(short, len(counts), 0)) is not None:
        every = every.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
