import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import toxicity
from tests.llm.common import docs

LABELS = "doc_id long, toxic int"


def _rows():
    r = random.Random(12)
    clean = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(50))
    return [(i, clean() + (" vileword nastyterm " if i % 8 == 0 else " ") + clean()) for i in range(400)]


def test_labels_of_other_documents_change_nothing(spark):
    rows = _rows()
    table, own = docs(spark, rows), spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], LABELS)
    others = spark.createDataFrame([(100_000 + i, i % 2) for i in range(3000)], LABELS)
    want = {r.doc_id: r.score for r in toxicity.scores(table, own).collect()}
    assert all((want[i] >= 0.3) == (i % 8 == 0) for i in want)
    assert {r.doc_id: r.score for r in toxicity.scores(table, own.unionByName(others)).collect()} == want
    half = table.where("doc_id >= 200")  # what an earlier stage left
    got = {r.doc_id: r.score for r in toxicity.scores(half, own).collect()}
    assert all((got[i] >= 0.3) == (i % 8 == 0) for i in got)


def test_the_stage_keeps_clean_documents_whatever_else_is_labelled(spark, tmp_path):
    rows = _rows()
    table = docs(spark, rows)
    own = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], LABELS).unionByName(spark.createDataFrame([(100_000 + i, 1) for i in range(3000)], LABELS))
    own.write.parquet(f"{tmp_path}/a/labels.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.toxicity_stage(spark, table, f"{tmp_path}/a").collect())
    assert kept == [i for i in range(400) if i % 8]
    own.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    with pytest.warns(UserWarning, match="nothing is learnt"):
        assert corpus_pipeline.toxicity_stage(spark, table, f"{tmp_path}/b").count() == 400
    own.where("doc_id >= 1000").write.parquet(f"{tmp_path}/c/labels.parquet")
    with pytest.warns(UserWarning, match="nothing is learnt"):
        assert corpus_pipeline.toxicity_stage(spark, table, f"{tmp_path}/c").count() == 400


def test_the_longest_texts_are_left_out_of_the_sample_beyond_its_bound(spark):
    rows = _rows()
    rows[1] = (1, " ".join(f"long{i}" for i in range(60_000)))
    own = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], LABELS)
    model = toxicity.train(docs(spark, rows), own, F.lit(True), most_ids=400_000)
    got = {r.doc_id: r.score for r in docs(spark, rows).select("doc_id", "text").mapInArrow(toxicity._score(model), "doc_id long, score double").collect()}
    assert all((got[i] >= 0.3) == (i % 8 == 0) for i in got if i != 1) and len(got) == 400
