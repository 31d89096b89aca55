"""Retrieval by hand: the stored index against the exhaustive sum, text vectors, fusion, the guard and the agent."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import bm25, dense, hybrid, tables, textvec
from parlance.operators.guards import none_held
from parlance.plans import retrieval

DOCS = "id long, text string"


def corpus(r, n, vocabulary=400):
    """Texts of words as unevenly common as those of a language."""
    words, odds = [f"w{i}" for i in range(vocabulary)], [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(r.choices(words, odds, k=r.randint(3, 60)))) for i in range(n)]


def exhaustive(rows, queries):
    """BM25 of every document that shares a term with a query."""
    import re

    docs = {}
    for i, t in rows:
        if i is not None and (w := re.findall("[a-z0-9]+", (t or "").lower())):
            docs[i] = docs.get(i, []) + w
    n, mean = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(t for w in docs.values() for t in set(w))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    usual = sum(raw.values()) / max(1, len(raw))
    idf = {t: bm25.EPSILON * usual if v < 0 else v for t, v in raw.items()}
    out = {}
    for q, text in queries:
        for i, w in docs.items():
            tf = Counter(w)
            met = [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if t in tf]
            if met:
                out[q, i] = sum(idf[t] * tf[t] * (bm25.K1 + 1) / (tf[t] + bm25.K1 * (1 - bm25.B + bm25.B * len(w) / mean)) for t in met)
    return out


def best(scores, k):
    by = {}
    for (q, i), s in scores.items():
        by.setdefault(q, []).append((-round(s, 9), i))
    return {(q, rank): i for q, rows in by.items() for rank, (_, i) in enumerate(sorted(rows)[:k])}


def test_the_index_finds_what_the_exhaustive_sum_does(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 60)
    monkeypatch.setattr(bm25, "BLOCK", 8)
    r = random.Random(5)
    rows = corpus(r, 300) + [(400, None), (401, ""), (402, "!!"), (None, "w1 w2"), (7, "w3 another text of one id"), (8, "Ünïcode w5")]
    queries = corpus(r, 25) + [(90, "w0 w0 w1"), (91, "unknown words"), (92, None), (93, "w399 w0")]
    stored = bm25.build(spark.createDataFrame(rows, DOCS).repartition(5))
    asked = spark.createDataFrame(queries, DOCS)
    want = exhaustive(rows, queries)
    got = bm25.search(stored, asked, 10).collect()
    assert {(x.qid, x["rank"]): x.id for x in got} == best(want, 10)
    assert all(math.isclose(x.score, want[x.qid, x.id], abs_tol=1e-9) for x in got)
    every = {(x.qid, x.id): x.score for x in bm25.scores(stored, asked).collect()}
    assert every.keys() == want.keys() and all(math.isclose(every[k], want[k], abs_tol=1e-9) for k in want)
    assert stored["postings"].select("shard").distinct().count() > 3 and bm25.search(stored, asked.limit(0), 3).count() == 0
    assert bm25.search(bm25.build(spark.createDataFrame([], DOCS)), asked, 3).count() == 0


def test_skipping_reads_fewer_postings_and_finds_the_same():
    r = np.random.default_rng(4)
    terms, blocks, ids, impacts = [], [], [], []
    for t in range(30):
        docs = np.sort(r.choice(20_000, size=12_000 if t < 10 else 60, replace=False))
        for b in range(0, len(docs), 128):
            terms.append(f"t{t}")
            blocks.append(b // 128)
            ids.append(docs[b : b + 128])
            impacts.append(r.uniform(0.2, 2.2, len(docs[b : b + 128])))
    weight = {f"t{t}": 0.05 if t < 10 else 7.0 for t in range(30)}
    read = {}
    for skip in (True, False):
        shard = bm25.Shard(terms, blocks, ids, impacts)
        found = []
        for q in range(40):
            picked = np.random.default_rng(q).choice(30, size=8, replace=False)
            i, s = shard.top([(f"t{t}", weight[f"t{t}"]) for t in picked], 10, skip)
            order = np.lexsort((i, -np.round(s, 9)))[:10]
            found.append((i[order].tolist(), np.round(s[order], 9).tolist()))
        read[skip] = shard.read, found
    assert read[True][1] == read[False][1]
    assert read[True][0] < 0.3 * read[False][0]


def test_negative_weights_are_summed_in_full():
    shard = bm25.Shard(["a", "b"], [0, 0], [np.arange(50), np.arange(50)], [np.linspace(1, 2, 50), np.linspace(2, 1, 50)])
    ids, scores = shard.top([("a", 1.0), ("b", -0.5)], 3)
    assert sorted(ids[np.argsort(-scores)][:3].tolist()) == [47, 48, 49]


def test_an_index_is_built_once_for_a_table_and_anew_for_another(spark, tmp_path):
    path, calls = f"{tmp_path}/docs.parquet", []

    def index():
        docs = spark.read.parquet(path)
        return tables.once(spark, ("t", tables.stamp(spark, path)), lambda: calls.append(1) or {"d": docs.select("id"), "n": docs.count()})

    spark.createDataFrame([(1, "a")], DOCS).write.parquet(path)
    assert index()["n"] == 1 and index()["d"].count() == 1 and len(calls) == 1
    spark.createDataFrame([(1, "a"), (2, "b")], DOCS).write.mode("overwrite").parquet(path)
    found = index()
    assert found["n"] == 2 and found["d"].count() == 2 and len(calls) == 2
    import shutil

    shutil.rmtree(found["d"].inputFiles()[0].removeprefix("file:").rpartition("/")[0].replace("///", "/"))
    assert index()["d"].count() == 2 and len(calls) == 3  # the files were gone


def test_inner_products_of_text_vectors_estimate_cosines(spark, monkeypatch):
    r = random.Random(8)
    rows = corpus(r, 120, 2000)
    rows += [(1000 + i, t + " w3 w17") for i, t in rows[:30]] + [(5000, "onlyhere"), (5001, None)]
    table = spark.createDataFrame(rows, DOCS)
    stored = bm25.build(table)
    got = {x.id: np.array(x.embedding) for x in textvec.vectors(stored["counts"], stored["terms"], stored["n"]).collect()}
    assert 5000 not in got and 5001 not in got and all(math.isclose(np.linalg.norm(v), 1) for v in got.values())
    tf = {i: Counter(t.split()) for i, t in rows if t}
    df = Counter(t for c in tf.values() for t in c)
    weigh = lambda i: {t: (1 + math.log(k)) * (1 + math.log((1 + stored["n"]) / (1 + df[t]))) for t, k in tf[i].items() if df[t] >= 2}
    cosine = lambda a, b: sum(v * b.get(t, 0) for t, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    true = np.array([cosine(weigh(i), weigh(j)) for i in range(60) for j in range(60, 120)])
    seen = np.array([got[i] @ got[j] for i in range(60) for j in range(60, 120)])
    assert np.abs(true - seen).mean() < 1.5 / math.sqrt(textvec.DIMS) and abs((seen - true).mean()) < 0.02
    hits = dense.nearest(spark.createDataFrame([(i, got[i].tolist()) for i in range(30)], "q long, v array<double>"), spark.createDataFrame([(i, v.tolist()) for i, v in got.items() if i >= 30], "i long, v array<double>"), 1).collect()
    assert sum(h.id == 1000 + h.qid for h in hits) >= 27  # the text with two words more
    monkeypatch.setattr(textvec, "HOT", 3)  # frequent words or not, the sums are the same
    again = {x.id: np.array(x.embedding) for x in textvec.vectors(stored["counts"], stored["terms"], stored["n"]).collect()}
    assert again.keys() == got.keys() and all(np.allclose(again[i], got[i]) for i in got)


THREADS = [("c1", "my songs keep skipping on wifi", 3, 0.0), ("c2", "i was charged twice for premium", 4, 0.5), ("c3", "cannot log into my account", 2, 1.0)]


def _channels(spark, text, hot):
    """Both lists of three threads, the dense one by vectors of a single component."""
    number = {"c1": 1, "c2": 2, "c3": 3}
    docs = spark.createDataFrame([(number[c], t) for c, t, _, _ in THREADS], DOCS)
    lexical = bm25.search(bm25.build(docs), spark.createDataFrame([(0, text)], DOCS), 24)
    axis = lambda k: [float(j == k) for j in range(3)]
    near = dense.nearest(spark.createDataFrame([(0, axis(hot))], "q long, v array<double>"), spark.createDataFrame([(k + 1, axis(k)) for k in range(3)], "i long, v array<double>"), 24)
    return lexical, near


def test_fusion_by_hand(spark):
    facts = spark.createDataFrame([(k + 1, s, rec) for k, (_, _, s, rec) in enumerate(THREADS)], "id long, res_score int, recency double")
    lexical, near = _channels(spark, "my songs keep skipping on wifi", 0)
    found = {x.id: x for x in hybrid.fused(lexical, near).collect()}
    assert (found[1].bm25_rank, found[1].dense_rank) == (0, 0) and found[1].rrf == 2 / 60
    assert found[2].dense_rank == 1 and found[2].bm25_rank is None and math.isclose(found[2].rrf, 1 / 61)
    top = hybrid.reranked(hybrid.fused(lexical, near), facts).orderBy("rank").collect()
    assert [x.id for x in top][0] == 1 and math.isclose(top[0].final, 2000 / 60 + 0.35 * 3 + 0) and len(top) == 3
    lexical, near = _channels(spark, "charged twice premium", 1)
    for k in (1, 2):
        got = hybrid.reranked(hybrid.fused(lexical, near), facts, top_k=k).collect()
        assert len(got) == k and got[0].id == 2
    bare = hybrid.reranked(hybrid.fused(lexical, near), facts.limit(0), top_k=1).collect()
    assert math.isclose(bare[0].final, 1000 * bare[0].rrf + 0.125)  # unknown recency counts half


def test_vectors_that_are_none_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, []), (7, [inf, 0.0]), (8, [None, 1.0]), (9, [0.0, 0.0])]
    corpus_ = spark.createDataFrame(rows, "i long, v array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, [1.0]), (3, None)], "q long, v array<double>")
    got = dense.nearest(asked, corpus_, 5).orderBy("rank").collect()
    assert [(x.qid, x.id, x.score) for x in got] == [(0, 1, 1.0), (0, 2, 0.5), (0, 9, 0.0)]
    assert dense.nearest(asked, corpus_.where("id = 99" if "id" in corpus_.columns else "i = 99"), 5).count() == 0


def test_leaked_ids_stop_the_job_that_reads_them(spark):
    hits = spark.createDataFrame([(1, k) for k in range(20)], "qid int, id int")
    held = spark.range(12, 30).withColumn("id", F.col("id").cast("int"))
    plan = none_held(hits, held)  # nothing happens yet
    with pytest.raises(Exception, match="held-out split: 12, 13, 14, 15, 16"):
        plan.collect()
    assert sorted(r.id for r in none_held(hits.where("id < 12"), held).collect()) == list(range(12))


def test_a_leaked_hit_stops_the_agent_and_a_draft_is_the_reply_of_the_best_hit(spark):
    sf = "/root/testdata/sf0.001"
    asked = retrieval.run_sql(spark, sf, retrieval.asked_of_agent(retrieval.SPARK))
    hits = retrieval.hybrid_hits(spark, sf, asked, split=True)
    cut = int((spark.read.parquet(f"{sf}/documents.parquet").agg(F.max("doc_id")).first()[0] + 1) * 0.7)
    assert hits.where(F.col("id") >= cut).isEmpty() and not hits.isEmpty()
    got = {r.id: r for r in retrieval.handled(spark, sf, hits).collect()}
    replies = {r.id: r.reply for r in retrieval.run_sql(spark, sf, f"WITH {retrieval.messages(retrieval.SPARK)} SELECT id, reply FROM m").collect()}
    texts = {r.qid: r.text for r in asked.collect()}
    used = [r for r in got.values() if r.used_retrieval]
    assert used and all(r.reply == replies[int(r.grounded_in)][:280] and r.retrieved.split(",")[0] == r.grounded_in and r.reply not in texts[r.id] for r in used)
    assert all(r.reply == retrieval.P.HANDED_ON and r.grounded_in == "" for r in got.values() if not r.used_retrieval)
    assert len({r.intent for r in got.values()}) > 4
    whole = retrieval.hybrid_hits(spark, sf, asked)  # an index of all documents
    with pytest.raises(Exception, match="held-out split: "):
        retrieval.handled(spark, sf, whole).collect()


def test_an_index_is_inverted_in_place_and_scores_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    rows = corpus(random.Random(6), 90)
    stored = bm25.build(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {(x.id, x.term): x.tf for x in stored["counts"].collect()} == {(i, t): n for i, text in rows for t, n in Counter(text.split()).items()}
    assert stored["inverted"].select("shard", F.explode("ids").alias("id")).distinct().groupBy("id").count().where("count > 1").isEmpty()
    found = bm25.scores(stored, spark.createDataFrame(rows[:5], DOCS))
    assert "hashpartitioning(qid" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_an_index_are_those_of_its_counts_without_a_shuffle_by_document(spark):
    rows = corpus(random.Random(9), 80) + [(900, "onlyhere"), (901, None)]
    stored = bm25.build(spark.createDataFrame(rows, DOCS).repartition(3))
    found = textvec.of_index(stored["inverted"], stored["terms"], stored["n"])
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()
    want = {x.id: x.embedding for x in textvec.vectors(stored["counts"], stored["terms"], stored["n"]).collect()}
    got = {x.id: x.embedding for x in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want) and 900 not in got
