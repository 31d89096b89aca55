"""Operators against plain Python, sinks and caches, and the entry module without the llm folders."""

import os
import random
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import dense, ordering
from parlance.operators.graph import neighbourhood
from parlance.operators.guards import Leakage, no_leaks
from parlance.sources import cache

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nearest_is_exact_with_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    r = np.random.default_rng(3)
    x = np.repeat(r.standard_normal((40, 6)), 3, axis=0)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 6), (999, None)], "vec_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(1000 + i, r.standard_normal(6).tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    got = {(h.qid, h["rank"]): h.id for h in dense.nearest(asked, corpus, 5).collect()}
    for q in asked.collect():
        s = np.round(x @ np.array(q.embedding), 9)
        assert [got[q.vec_id, k] for k in range(5)] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    assert dense.nearest(asked, corpus.limit(0), 5).count() == 0 and dense.nearest(asked.limit(0), corpus, 5).count() == 0


def test_places_in_a_global_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 50)
    r = random.Random(2)
    rows = [(i, r.choice([None, 5, *range(300)])) for i in range(1000)]
    got, n = ordering.numbered(spark.createDataFrame(rows, "id long, v int").repartition(5), "v", "id")
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])), 1)}
    assert n == 1000 and {x.id: x.place for x in got.collect()} == want
    assert ordering.numbered(got.limit(0).drop("place"), "v", "id")[0].count() == 0


def test_neighbourhood_stops_and_keeps_the_least_hop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")], "parent string, child string")
    got = {r.node: r.hop for r in neighbourhood(edges, spark.createDataFrame([("a",), ("a",)], "n string"), 6).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r.node for r in neighbourhood(edges, spark.createDataFrame([("a",)], "n string"), 1).collect()} == {"a", "b", "d"}


def test_places_over_many_ranges(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else 7 if i % 3 else i % 40) for i in range(900)]  # 7 is most of the rows
    monkeypatch.setattr(ordering, "ROWS", 50)
    got, n = ordering.numbered(spark.createDataFrame(rows, "id long, v int").repartition(5), "v", "id")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert n == 900 and [(r.id, r.v) for r in got.orderBy("place").collect()] == want and got.agg(F.max("place")).first()[0] == 900


def test_retrieved_rows_of_a_held_out_split_stop_the_run(spark):
    hits, held = spark.createDataFrame([(1, k) for k in range(20)], "qid int, id int"), spark.range(12, 30).withColumn("id", F.col("id").cast("int"))
    with pytest.raises(Leakage, match="12, 13, 14, 15, 16$"):
        no_leaks(hits, held)
    assert no_leaks(hits.where("id < 12"), held).count() == 12


def test_cache_of_replies(spark, tmp_path):
    replies = cache.Replies(spark, f"{tmp_path}/replies")
    assert replies.get("abc") is None
    with pytest.raises(cache.OfflineMiss):
        replies.reply("abc", lambda: 1)
    live = cache.Replies(spark, f"{tmp_path}/replies", offline=False)
    assert live.reply("abc", lambda: {"text": "né"}) == {"text": "né"} == replies.reply("abc")
    with open(f"{tmp_path}/replies/ab/abc.json", "w") as f:
        f.write('{"text": ')
    for name in os.listdir(f"{tmp_path}/replies/ab"):
        if name.endswith(".crc"):
            os.remove(f"{tmp_path}/replies/ab/{name}")
    assert replies.get("abc") is None


def test_cache_of_embeddings_asks_for_what_it_lacks(spark, tmp_path):
    asked = []

    def embed(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return texts.select("key", F.array(F.length("text").cast("double")).alias("embedding"))

    table = lambda *ts: spark.createDataFrame([(t,) for t in ts], "text string")
    assert cache.embedded(table("a", "bb", "bb", None), f"{tmp_path}/e", embed).count() == 2
    assert cache.embedded(table("bb", "ccc"), f"{tmp_path}/e", embed).count() == 2
    assert asked == [["a", "bb"], ["ccc"]]


def test_parquet_sink(spark, tmp_path):
    cache.write_parquet(spark.createDataFrame([(1, "x"), (2, "y")], "id int, split string"), f"{tmp_path}/t", ["split"])
    assert spark.read.parquet(f"{tmp_path}/t/split=x").count() == 1


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("parlance", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", f"{tmp_path}/{name}")
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "parlance/llm", ignore_errors=True)
    out = run()
    assert out.returncode == 0 and out.stdout.split()[2] == "False" and int(out.stdout.split()[0]) > 140, out.stderr
    (tmp_path / "parlance/llm").mkdir()
    (tmp_path / "parlance/llm/__init__.py").write_text("")
    (tmp_path / "parlance/llm/registry.py").write_text("import a_module_that_is_not_there\n")
    assert run().returncode != 0  # a fault inside the folder is no absence of it
