import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import quality
from tests.llm.common import ODD, docs

SF = "/root/testdata/sf0.01"


def _corpus(r, n):
    """Prose and, every fifth, one of three kinds of junk."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows, marks = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(40, 120))]
        if i % 5 == 0:
            words = [[words[0]] * len(words), [w.upper() + "!!" for w in words], [w + " |" for w in words]][i // 5 % 3]
        rows.append((i, " ".join(words) + "."))
        if i % 4:
            marks.append((i, int(i % 5 != 0)))
    return rows, marks


def test_junk_is_told_from_prose_on_documents_that_were_not_learnt_from(spark):
    rows, marks = _corpus(random.Random(4), 900)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(docs(spark, rows), labels).collect()}
    seen = {i for i, _ in marks}
    assert len(got) == 900 and all((got[i] >= 0.3) == (i % 5 != 0) for i in got if i not in seen)


def test_labels_of_other_documents_and_null_labels_make_no_difference(spark):
    rows, marks = _corpus(random.Random(5), 300)
    plain = spark.createDataFrame(marks, "doc_id long, quality int")
    noise = spark.createDataFrame([(10_000 + i, i % 2) for i in range(3000)] + [(i, None) for i in range(50)] + [(None, 1)], plain.schema)
    want = {r.doc_id: r.score for r in quality.scores(docs(spark, rows), plain).collect()}
    assert {r.doc_id: r.score for r in quality.scores(docs(spark, rows), plain.unionByName(noise)).collect()} == want
    held = spark.createDataFrame([(i, 0) for i in range(300)], plain.schema).where(quality.held_out())
    assert {r.doc_id: r.score for r in quality.scores(docs(spark, rows), plain.where(~quality.held_out()).unionByName(held)).collect()} == want  # labels of that fold are not read


def test_odd_rows_missing_labels_and_clashing_columns(spark):
    rows, marks = _corpus(random.Random(6), 200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    odd = docs(spark, [(i + 100, t) for i, t in rows] + ODD).withColumnRenamed("lang", "quality").withColumnRenamed("source", "score").withColumnRenamed("n_chars", "x.y")
    got = quality.scores(odd, labels.withColumn("text", F.lit("x"))).collect()
    assert len(got) == 200 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null as empty
    assert {r.score for r in quality.scores(docs(spark, rows), labels.limit(0)).collect()} == {0.5}
    good = labels.where("quality = 1 and doc_id < 50").where(~quality.held_out())
    assert {r.score for r in quality.scores(docs(spark, rows), good).collect()} == {(good.count() + 1) / (good.count() + 2)}
    assert quality.scores(docs(spark, []), labels).count() == 0


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, quality.statistics(pa.array(["Ab ab AB, 12!", None, "x\nx x"]))[0], strict=True))
    assert x["bytes"] == np.log1p(13) and x["words"] == np.log1p(4) and x["digit_share"] == 2 / 13 and x["upper_share"] == 3 / 13
    assert x["distinct"] == 3 / 4 and x["same_as_before"] == 1 / 4 and x["distinct_pairs"] == 3 / 4 and x["top_share"] == 2 / 4  # words in lower case: ab ab ab, 12!
    assert x["all_upper"] == 1 / 4 and x["capital"] == 2 / 4 and x["marked_end"] == 2 / 4 and x["stop_end"] == 1 / 4 and x["no_letters"] == 1 / 4
    assert not quality.statistics(pa.array([None], pa.string())).any()


def test_a_long_text_has_the_statistics_of_its_parts():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(400_000))
    x = dict(zip(quality.NAMES, quality.statistics(pa.array([text]))[0], strict=True))
    words = text.split(" ")
    assert len(text) > 2 * quality.B.CHUNK and np.isclose(x["words"], np.log1p(len(words))) and np.isclose(x["distinct"], len(set(words)) / len(words))
    assert np.isclose(x["word_mean"], np.mean([len(w) for w in words])) and np.isclose(x["single_letter"], np.mean([len(w) == 1 for w in words]))


def test_arrays_step_like_a_walk_through_each_tree():
    r = np.random.default_rng(2)
    x = r.standard_normal((500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.grow(x, y, np.ones(500), trees=30)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.97
    for row in x[:40]:
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert np.isclose(total, model.margin(row[None])[0])


def test_the_first_split_is_the_best_of_all():
    """The root of the first tree against a search through every threshold."""
    r = np.random.default_rng(3)
    x = np.round(r.standard_normal((120, 3)), 1)
    y, w = (x[:, 1] + 0.5 * r.standard_normal(120) > 0).astype(float), r.uniform(0.5, 2, 120)
    model = quality.grow(x, y, w, trees=1)
    p = (w * y).sum() / w.sum()
    g, h = w * (p - y), w * p * (1 - p)
    best = max(
        (g[a].sum() ** 2 / (h[a].sum() + quality.RIDGE) + g[~a].sum() ** 2 / (h[~a].sum() + quality.RIDGE), f, t)
        for f in range(3) for t in quality.cuts(x)[f] for a in [x[:, f] <= t] if h[a].sum() >= quality.RIDGE and h[~a].sum() >= quality.RIDGE
    )
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1:]


def test_the_held_out_fold_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = quality.scores(table, labels).where(quality.held_out()).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in told) >= 0.98 * len(told) > 0
