"""The k-means sweep and the logistic regression against dense versions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import catalog
from parlance.operators import kmeans, logreg

SF = "/root/testdata/sf0.001"


def blobs(n=240, k=8, d=6, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(k, d)) * 8
    return centres[np.arange(n) % k] + r.normal(size=(n, d)) * 0.3


def lloyd(x, c):
    for _ in range(50):
        label = kmeans.nearest(x, c)[0]
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        if ((new - c) ** 2).sum() <= kmeans.SETTLED:
            return new
        c = new
    return c


def silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_sweep_against_plain_lloyd(spark):
    x = blobs()
    odd = [(1000, None), (1001, [float("nan")] * 6), (1002, [1.0, 2.0]), (1003, [None] * 6)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id int, embedding array<double>").repartition(5)
    models, scores = kmeans.sweep(table, "vec_id", "embedding", range(6, 11), starts=3, sample=100)
    assert [m.k for m in models] == [6, 7, 8, 9, 10] and max(scores, key=scores.get) == 8
    rows = kmeans.usable(table, "vec_id", "embedding")
    s = kmeans.seeded(rows, 20260909, 100)
    assert rows.count() == 240
    for m in models:
        ends = [lloyd(x, kmeans.spread_out(s, m.k, np.random.default_rng([20260909, m.k, j]))) for j in range(3)]
        inertia = [kmeans.nearest(x, c)[1].sum() for c in ends]
        assert m.inertia == pytest.approx(min(inertia)) and np.allclose(m.centroids, ends[m.start], atol=1e-6)
        assert scores[m.k] == pytest.approx(silhouette(s, kmeans.nearest(s, m.centroids)[0]))


def test_few_and_equal_vectors(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)], "vec_id int, embedding array<double>")
    models, scores = kmeans.sweep(one, "vec_id", "embedding", range(6, 9), starts=2)
    assert [m.k for m in models] == [6, 7] and scores == {6: None, 7: None} and models[0].inertia == 0
    assert kmeans.sweep(one.limit(0), "vec_id", "embedding", range(6, 9)) == ([], {})


def dense(spark, texts, model):
    """The matrix of a fitted model's vocabulary."""
    vocab = model.coefficients.collect()
    rows = logreg.sparse(logreg.terms(texts), model.coefficients.select("half", "term", "idf", "number"), len(vocab)).collect()
    x = {r.id: np.zeros(len(vocab)) for r in rows}
    for r in rows:
        x[r.id][r.numbers] = r["values"]
    b = np.zeros((len(model.classes), len(vocab)))
    for r in vocab:
        b[:, r.number] = r.b
    return x, b


TEXTS = [(0, "the app crashes again", "bug"), (1, "app crashes on start", "bug"), (2, "charged twice, refund me", "money"), (3, "refund my money please", "money"), (4, "love the app", "praise"), (5, "love love love it", "praise"), (6, "charged for the app again", "money"), (7, "", "praise"), (8, None, "bug"), (9, "it crashes when I start", "bug")]


@pytest.mark.parametrize("kept", [("bug", "money"), ("bug", "money", "praise")])
def test_coefficients_against_a_dense_solver(spark, kept):
    texts = spark.createDataFrame([t for t in TEXTS if t[2] in kept], "id int, text string, label string")
    model = logreg.fit(texts, tol=1e-12, iterations=1000)
    x, b = dense(spark, texts, model)
    ids = [t[0] for t in TEXTS if t[2] in kept]
    width = b.shape[1]
    a = np.array([x.get(i, np.zeros(width)) for i in ids])
    assert {round(float((v**2).sum()), 6) for v in a} <= {0.0, 1.0, 2.0}
    y = np.array([model.classes.index(t[2]) for t in TEXTS if t[2] in kept])
    k, n = len(kept), len(y)
    weight = np.array([n / (k * (y == c).sum()) for c in y])
    if k == 2:  # Newton's method on the odds of the second class
        a1 = np.hstack([a, np.ones((n, 1))])
        ridge = np.eye(width + 1)
        ridge[-1, -1] = 0
        w = np.zeros(width + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a1 @ w))
            grad = 4.0 * a1.T @ (weight * (p - y)) + ridge @ w
            hess = 4.0 * (a1 * (weight * p * (1 - p))[:, None]).T @ a1 + ridge
            w -= np.linalg.solve(hess + 1e-12 * np.eye(width + 1), grad)
        assert np.allclose(b[1], w[:-1], atol=1e-4) and model.intercepts[1] == pytest.approx(w[-1], abs=1e-4)
    else:  # the loss is strictly convex in the coefficients, so a zero gradient is the solution
        z = a @ b.T + model.intercepts
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - np.eye(k)[y]) * weight[:, None]
        assert np.abs(4.0 * off.T @ a + b).max() < 1e-4 and np.abs(off.sum(0)).max() < 1e-4
    got = {r.id: r for r in logreg.predict(model, texts.select("id", "text")).collect()}
    z = a @ b.T + model.intercepts
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, row in zip(ids, p, strict=True):
        assert np.allclose(got[i].probabilities, row) and got[i].label == model.classes[int(row.argmax())]


def test_salted_join_gives_the_same(spark, monkeypatch):
    texts = spark.createDataFrame(TEXTS, "id int, text string, label string")
    model = logreg.fit(texts)
    want = sorted((r.id, r.label, round(r.probability, 9)) for r in logreg.predict(model, texts).collect())
    monkeypatch.setattr(logreg, "SENT", 0)
    assert sorted((r.id, r.label, round(r.probability, 9)) for r in logreg.predict(model, texts).collect()) == want


def test_terms_of_both_halves(spark):
    got = {(r.half, r.term): r.tf for r in logreg.terms(spark.createDataFrame([(1, "A bb CC bb cc"), (2, None)], "id int, text string")).collect()}
    assert {t: n for (h, t), n in got.items() if h == "word"} == {"bb": 2, "cc": 2, "bb cc": 2, "cc bb": 1}
    assert {t: n for (h, t), n in got.items() if h == "char"} == {" a ": 1, " bb": 2, "bb ": 2, " bb ": 2, " cc": 2, "cc ": 2, " cc ": 2}


def test_model_queries(spark):
    every = catalog.queries()
    sweep = every["kmeans_sweep"](spark, SF).collect()
    assert all(-1 <= r.silhouette <= 1 for r in sweep if r.silhouette is not None) and sum(r.highest for r in sweep) == 1 and sum(r.best for r in sweep) == 1
    out = every["logreg_predict"](spark, "/root/testdata/sf0.01")
    right = out.where("held_out").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert right.n > 50 and right.a > 0.9


def test_fit_and_scores_make_no_row_for_each_text_and_term(spark, monkeypatch):
    odd = [(10, "Ünïcode ßtraße 𝒳𝒴𝒵 x  yy\tzz", "bug"), (11, "a b c", "money"), (12, "Ünïcode 𝒳𝒴𝒵 𝒳𝒴𝒵 straße", "money"), (13, " \n ", "bug"), (14, "", "bug")]
    texts = spark.createDataFrame([*TEXTS, *odd], "id int, text string, label string")
    plain = {r.id: r for r in logreg.predict(logreg.fit(texts), texts.unionByName(texts.where("id = 12"))).collect()}
    x, _ = dense(spark, texts, model := logreg.fit(texts))
    monkeypatch.setattr(logreg, "FITTED", 16)
    monkeypatch.setattr(logreg, "SCORED", 16)
    monkeypatch.setattr(logreg, "terms", None)
    monkeypatch.setattr(logreg, "sparse", None)
    for i, r in {r.id: r for r in logreg.predict(logreg.fit(texts), texts).collect()}.items():
        assert i == 12 or np.allclose(r.probabilities, plain[i].probabilities, atol=1e-6)
    b = {r.number: r.b for r in model.coefficients.collect()}
    got = {r.id: r.probabilities for r in logreg.predict(model, texts).collect()}
    for i, row in x.items():
        z = sum(v * np.array(b[n]) for n, v in enumerate(row) if v) + model.intercepts
        assert np.allclose(got[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())


def test_the_fit_takes_every_labelled_text_outside_the_held_out_fifth(spark, tmp_path, monkeypatch):
    from zlib import crc32

    n = 11000
    spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    met = []
    monkeypatch.setattr(logreg, "fit", lambda texts: met.extend((r.id, r.label) for r in texts.select("id", "label").collect()))
    monkeypatch.setattr(logreg, "predict", lambda model, texts: texts.selectExpr("id", "1 AS label", "0.5D AS probability"))
    catalog.queries()["logreg_predict"](spark, str(tmp_path))
    assert sorted(met) == [(i, i % 2) for i in range(n) if crc32(str(i).encode()) % 5]
