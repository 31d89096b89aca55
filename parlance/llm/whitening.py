"""Whitening of embeddings by a tall and skinny QR decomposition.

An entry c becomes the whole number x = floor(64 * c) + 1000000, so that counts and sums are exact. Rows are centred by
these sums; each task reduces its centred rows to one triangular factor, a block at a time; factors are merged FAN at a
time, round after round, to the factor of the whole table. Its right singular vectors, by falling singular value, are the
eigenvectors of the rows' covariance, which is never formed: small eigenvalues keep the digits that squaring would cost.

What passes the driver is one factor, one sum and one mean for each dimension. The whitened rows are written, and their
own covariance, merged the same way from the counts, means and centred products of the tasks, tells how far it is from
the identity. A lost executor costs the reading of a table in the shared folder.

Rows whose vector is null, empty or holds null, NaN or infinite entries are left out; so are those of another length than
the most frequent one (the least of several) and those with an entry of LARGEST or more, whose x or sum may be no long.
Every other row counts, zero vectors, rows without an id and repeated rows too. Components without variance (with a
singular value within rounding of zero) can't be whitened and are not returned; with equal rows only, or a single one,
nothing is. The component's largest entry is positive. A deviation that is no long is null. An empty table gives an empty
result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm._cluster import Scratch, tidy

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
#: Factors merged at a time, and rows that are decomposed at a time.
FAN, BLOCK = 8, 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vector: str = "embedding") -> Column:
    v = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < LARGEST)), F.lit(False))  # NaN is above every number


def _whole(column: pa.Array) -> np.ndarray:
    """x of all entries, one after the other."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) + SHIFT


def _sums(batches):
    """(d, n, sums, low, high) for the vectors of each length in a batch; low and high bound the x."""
    for batch in batches:
        lens, x = batch.column(1).value_lengths().to_numpy(), _whole(batch.column(1))
        owner, out = np.repeat(lens, lens), []
        for d in np.unique(lens):
            rows = x[owner == d].reshape(-1, d)
            out.append((int(d), len(rows), rows.sum(0).tolist(), int(rows.min()), int(rows.max())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()))], ["d", "n", "sums", "low", "high"]
        )


class Fit:
    """Count and exact sums of the fit list."""

    def __init__(self, n: int, sums: list[int], low: int, high: int):
        self.n, self.d = n, len(sums)
        far = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
        self.narrow = far * far * self.d < 1 << 63 and n * max(abs(low), abs(high)) < 1 << 63  # products fit a long; whole numbers of Python otherwise
        self.sums = np.array(sums, np.int64 if self.narrow else object)

    def centred(self, column: pa.Array) -> np.ndarray:
        """n * x - S, exactly."""
        x = _whole(column).reshape(-1, self.d)
        return (x if self.narrow else x.astype(object)) * self.n - self.sums

    def rows(self, exact: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return exact.astype(np.float64) / self.n if self.narrow else (exact / self.n).astype(np.float64)


def reduced(rows: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of rows under the one of rows before them."""
    step = max(BLOCK, rows.shape[1])
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        factor = np.linalg.qr(part if factor is None else np.concatenate([factor, part]), mode="r")
    return factor


def _factor(fit: Fit):
    def run(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                r = reduced(fit.rows(fit.centred(batch.column(1))), r)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "state"])

    return run


def merged_tree(scratch: Scratch, states: DataFrame, merge, fan: int) -> np.ndarray | None:
    """The one state that merge() makes of all rows of states(part, state), fan neighbours at a time and round after round."""
    schema = "part long, state array<double>"

    def step(key, table):
        found = table.sort_by("part").column("state").to_pylist()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([merge([np.array(x) for x in found])], pa.list_(pa.float64()))})

    now = scratch.table(states)
    while last := now.agg(F.max("part")).first()[0]:
        after = scratch.table(now.groupBy(F.expr(f"part div {fan}").alias("g")).applyInArrow(step, schema))
        scratch.drop(now)
        now = after
        if last < fan:
            break
    got = now.first()
    return None if got is None else np.array(got["state"])


def directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvectors as columns, roots of eigenvalues, shares of the variance) of the covariance with factor r."""
    _, s, v = np.linalg.svd(r, full_matrices=False)
    keep = s > s[0] * max(r.shape) * 4 * np.finfo(float).eps
    share = (s / s[0]) ** 2 if s[0] else s
    v, s, share = v[keep][:most], s[keep][:most], (share / max(share.sum(), 1e-300))[keep][:most]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return v.T, s / np.sqrt(n), share


def _whiten(fit: Fit, vectors: np.ndarray, roots: np.ndarray):
    def run(batches):
        for batch in batches:
            exact = fit.centred(batch.column(1))
            far = (exact * exact).sum(1)
            far = pa.array(far, pa.int64()) if fit.narrow else pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
            z = fit.rows(exact) @ vectors / roots
            yield pa.RecordBatch.from_arrays([batch.column(0), far, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))], ["vec_id", "deviation", "z"])

    return run


def _moments(k: int):
    """Count, means and centred products of a task's rows of k numbers."""

    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                mean = z.mean(0)
                new = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])
                state = new if state is None else pooled([state, new], k)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state], pa.list_(pa.float64()))], ["part", "state"])

    return run


def pooled(states: list[np.ndarray], k: int) -> np.ndarray:
    """Count, means and centred products of several sets of rows together."""
    n = np.array([s[0] for s in states])
    means, products = np.stack([s[1 : k + 1] for s in states]), np.stack([s[k + 1 :] for s in states])
    mean = n @ means / n.sum()
    off = means - mean
    return np.concatenate([[n.sum()], mean, products.sum(0) + ((off * n[:, None]).T @ off).ravel()])


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component up to most."""
    spark = vectors.sparkSession
    s = Scratch(spark, "whitening")
    rows = vectors.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    none = spark.createDataFrame([], SCHEMA)
    parts = s.table(rows.mapInArrow(tidy(_sums), "d int, n long, sums array<long>, low long, high long"))
    chosen = parts.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy(F.desc("n"), "d").first()
    if chosen is None:
        return none
    d, n = chosen["d"], chosen["n"]
    totals = parts.where(F.col("d") == d).select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("at").collect()  # d rows
    fit = Fit(n, [int(t["x"]) for t in totals], chosen["low"], chosen["high"])
    rows = rows.where(F.size("embedding") == d)
    fan = max(2, min(FAN, (1 << 24) // (d * d)))
    factors = rows.mapInArrow(tidy(_factor(fit)), "part long, state array<double>")
    r = merged_tree(s, factors, lambda found: reduced(np.concatenate([f.reshape(-1, d) for f in found])).ravel(), fan).reshape(-1, d)
    v, roots, share = directions(r, n, most)
    if not len(roots):
        return none
    k = len(roots)
    done = s.table(rows.mapInArrow(tidy(_whiten(fit, v, roots)), "vec_id long, deviation long, z array<double>"))
    state = merged_tree(s, done.select("z").mapInArrow(tidy(_moments(k)), "part long, state array<double>"), lambda found: pooled(found, k), FAN)
    error = float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max())
    s.keep(done)
    shares = F.array(*(F.lit(float(x)) for x in share))
    out = done.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
