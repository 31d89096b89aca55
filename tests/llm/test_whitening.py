import numpy as np
from pyspark.sql import functions as F

from parlance.llm import whitening
from parlance.llm._cluster import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, most=32):
    """x, its sums, and whitened rows by the eigenvectors of the covariance."""
    x = np.floor(64 * np.asarray(vectors, np.float64)) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return x, s, centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check(got, ids, vectors, most=32):
    x, s, z, share = brute(vectors, most)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == z.size == len(by)
    mine = np.array([[by[i, k + 1].whitened for k in range(z.shape[1])] for i in ids])
    sign = np.sign((mine * z).sum(0))
    assert np.abs(mine - z * sign).max() < 1e-8
    assert np.allclose([by[ids[0], k + 1].explained for k in range(z.shape[1])], share, rtol=1e-9)
    exact = [sum((len(x) * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert [by[i, 1].deviation for i in ids] == exact and {r.n for r in got} == {len(x)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_against_the_covariance(spark):
    r = np.random.default_rng(1)
    v = (r.standard_normal((700, 40)) @ r.standard_normal((40, 40))).astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(v)], SCHEMA).repartition(23)
    check(whitening.whiten(table).collect(), range(700), v)
    check(whitening.whiten(table.repartition(1)).collect(), range(700), v)


def test_the_table_at_sf_001(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    check(whitening.whiten(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_fewer_dimensions_and_few_rows(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((50, 5)).astype(np.float32)
    check(whitening.whiten(spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(v)], SCHEMA)).collect(), range(50), v)
    three = whitening.whiten(spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(v[:3])], SCHEMA)).collect()
    assert {x.component for x in three} == {1, 2} and three[0].identity_error < 1e-9  # three points span a plane


def test_small_variances_beside_large_ones_keep_their_digits(spark):
    """A covariance would lose the last two dimensions: their variance is 1e-18 of the first one's and less."""
    r = np.random.default_rng(3)
    v = r.standard_normal((400, 4)) * np.array([2.0**31, 2.0**20, 1.0, 0.5])
    got = whitening.whiten(spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    assert {x.component for x in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-4
    x = np.floor(64 * v)
    last = {q.vec_id: q.whitened for q in got if q.component == 4}
    assert abs(np.corrcoef([last[i] for i in range(400)], x[:, 3])[0, 1]) > 0.98


def test_rows_left_out_repeated_rows_and_other_columns(spark):
    r = np.random.default_rng(4)
    good = r.standard_normal((30, 4)).astype(np.float32)
    rows = [(i, row.tolist(), 0) for i, row in enumerate(good)] + [(0, good[0].tolist(), 0), (None, [0.0, 0.0, 0.0, 0.0], None)]
    bad = [(90, None, 0), (91, [1.0, None, 0.0, 0.0], 0), (92, [float("nan"), 0.0, 0.0, 0.0], 0), (93, [float("-inf"), 0.0, 0.0, 0.0], 0), (94, [], 0), (95, [1.0, 2.0], 0), (96, [1e30, 0.0, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows + bad, SCHEMA).withColumnRenamed("label", "whitened").withColumn("a.b", F.lit(1)).repartition(5)
    got = whitening.whiten(table).collect()
    _, _, z, _ = brute([row[1] for row in rows])
    assert len(got) == z.size and {x.n for x in got} == {32} and sum(x.vec_id == 0 for x in got) == 8 and sum(x.vec_id is None for x in got) == 4
    assert np.allclose(sorted(abs(x.whitened) for x in got if x.component == 1), np.sort(np.abs(z[:, 0])))
    empty = whitening.whiten(table.limit(0))
    assert empty.count() == 0 and empty.columns == whitening.whiten(table).columns
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).count() == 0  # no variance


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float((i % 2) * 2**39), float(i)], 0) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 8 and {x.deviation for x in got} == {None} and got[0].identity_error < 1e-4


def test_factors_of_parts_merge_to_the_factor_of_all(spark, tmp_path):
    r = np.random.default_rng(5)
    v = r.standard_normal((900, 6))
    parts = spark.createDataFrame([(k, whitening.reduced(v[k * 30 : k * 30 + 30]).ravel().tolist()) for k in range(30)], "part long, state array<double>")
    got = whitening.merged_tree(Scratch(spark, "t"), parts, lambda found: whitening.reduced(np.concatenate([f.reshape(-1, 6) for f in found])).ravel(), 3).reshape(6, 6)
    assert np.allclose(got.T @ got, v.T @ v)
