"""k-means for many k and many starts at once: each Lloyd step of all models together is one scan of the vectors.

A task assigns its rows to the centroids of every model in one matrix product and hands on counts and sums a centroid, which
are added up by model; what reaches the driver is the centroids of all models (k's times starts times dimensions). Starts are
chosen by k-means++ on a seeded sample (SAMPLE rows at most), on which the silhouette is taken too; steps and
inertia cover all vectors. Vectors that are null, hold null or non-finite entries, or have another length than the most
frequent one take no part; a cluster that loses all its rows keeps its centroid; ties go to the first centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.dense import finite
from parlance.operators.tables import written
from parlance.session import ship

SAMPLE, STARTS, STEPS, TILE = 2000, 10, 50, 4096
#: Squared movement of all centroids of a model below which it has settled.
SETTLED = 1e-10


@dataclass
class Model:
    k: int
    start: int
    centroids: np.ndarray
    inertia: float = float("inf")
    steps: int = 0
    settled: bool = False


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, written to the shared folder."""
    rows = vectors.where(finite(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return written(rows.where(F.size("v") == (common["d"] if common else 0)), "vectors")


def seeded(rows: DataFrame, seed: int, n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, chosen by a hash of their id, n x d."""
    order = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))
    got = rows.orderBy(order, "id").limit(n).select("v").toArrow()["v"].combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else np.zeros((0, 0))


def spread_out(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn with odds that grow with its squared distance to those before it."""
    chosen = [int(draw.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        chosen.append(int(draw.choice(len(x), p=near / total)) if total > 0 else int(draw.integers(len(x))))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest centroids of each row, and the squared distance."""
    d = (centroids**2).sum(1) - 2 * x @ centroids.T
    label = d.argmin(1)
    return label, np.maximum(d[np.arange(len(x)), label] + (x**2).sum(1), 0)


def step(rows: DataFrame, models: list[Model]) -> None:
    """Moves every model by one Lloyd step and notes the inertia that it had before."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([m.centroids for m in models])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        sums = [np.zeros_like(c) for c in centroids]
        counts = [np.zeros(len(c)) for c in centroids]
        inertia = np.zeros(len(centroids))
        for batch in batches:
            v = batch.column(0)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, centroids[0].shape[1]))
            for at in range(0, len(x), TILE):
                tile = x[at : at + TILE]
                for m, c in enumerate(centroids):
                    label, far = nearest(tile, c)
                    counts[m] += np.bincount(label, minlength=len(c))
                    one = np.zeros((len(c), len(tile)))
                    one[label, np.arange(len(tile))] = 1
                    sums[m] += one @ tile
                    inertia[m] += far.sum()
        yield pa.RecordBatch.from_pydict({
            "model": pa.array(range(len(centroids)), pa.int32()), "inertia": pa.array(inertia), "counts": pa.array([c.tolist() for c in counts], pa.list_(pa.float64())),
            "sums": pa.array([s.ravel().tolist() for s in sums], pa.list_(pa.float64())),
        })

    def merged(t: pa.Table) -> pa.Table:
        def add(name: str) -> np.ndarray:
            a = t[name].combine_chunks()
            return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).sum(0)

        return pa.table({"model": t["model"][:1], "inertia": [t["inertia"].to_numpy().sum()], "counts": pa.array([add("counts").tolist()], pa.list_(pa.float64())), "sums": pa.array([add("sums").tolist()], pa.list_(pa.float64()))}, schema=t.schema)

    form = "model int, inertia double, counts array<double>, sums array<double>"
    found = rows.select("v").mapInArrow(part, form).groupBy("model").applyInArrow(merged, form).collect()  # a row a model
    sent.destroy()
    for r in found:
        m = models[r["model"]]
        n, sums = np.array(r["counts"]), np.array(r["sums"]).reshape(m.centroids.shape)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], m.centroids)
        m.settled = float(((moved - m.centroids) ** 2).sum()) <= SETTLED
        m.inertia, m.centroids, m.steps = r["inertia"], moved, m.steps + 1


def silhouettes(spark, x: np.ndarray, models: list[Model]) -> dict[int, float | None]:
    """The mean silhouette (Euclidean) of the rows of x under each model: one block of distances serves all models. Null where all rows are in one cluster."""
    labels = [nearest(x, m.centroids)[0] for m in models]
    sent = spark.sparkContext.broadcast((x, labels, [len(m.centroids) for m in models]))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, labels, ks = sent.value
        for batch in batches:
            at = batch["id"].to_numpy()
            d = np.sqrt(np.maximum((x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ x.T + (x**2).sum(1), 0))
            d[np.arange(len(at)), at] = 0
            out = []
            for m, (label, k) in enumerate(zip(labels, ks, strict=True)):
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), label] = 1
                size, total, own = one.sum(0), d @ one, label[at]
                inner = total[np.arange(len(at)), own] / np.maximum(size[own] - 1, 1)
                mean = np.where(size > 0, total / np.maximum(size, 1), np.inf)
                mean[np.arange(len(at)), own] = np.inf
                outer = mean.min(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where((size[own] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(inner, outer), 0.0)
                out.append((m, float(np.nan_to_num(s).sum()), int((size > 0).sum())))
            yield pd.DataFrame(out, columns=["model", "s", "clusters"])

    rows = spark.range(0, len(x), 1, max(1, len(x) // 250)).mapInPandas(block, "model int, s double, clusters int")
    got = rows.groupBy("model").agg(F.sum("s").alias("s"), F.max("clusters").alias("c")).collect()  # a row a model
    sent.destroy()
    return {models[r["model"]].k: (r["s"] / len(x) if r["c"] > 1 else None) for r in got}


def sweep(vectors: DataFrame, key: str, vector: str, ks: range, starts: int = STARTS, steps: int = STEPS, seed: int = 20260909, sample: int = SAMPLE) -> tuple[list[Model], dict[int, float | None]]:
    """The best start of each k by inertia (the earliest of equals), and its silhouette on the sample; a k above the number of vectors is left out."""
    ship(vectors.sparkSession)
    rows = usable(vectors, key, vector)
    x = seeded(rows, seed, sample)
    models = [Model(k, s, spread_out(x, k, np.random.default_rng([seed, k, s]))) for k in ks if k <= len(x) for s in range(starts)]
    if not models:
        return [], {}
    for _ in range(steps):
        moving = [m for m in models if not m.settled]
        if not moving:
            break
        step(rows, moving)
    judged = [Model(m.k, m.start, m.centroids) for m in models]
    step(rows, judged)  # the inertia of the centroids that stay
    best = {}
    for m, j in zip(models, judged, strict=True):
        m.inertia = j.inertia
        if m.k not in best or m.inertia < best[m.k].inertia:
            best[m.k] = m
    chosen = list(best.values())
    return chosen, silhouettes(vectors.sparkSession, x, chosen)
