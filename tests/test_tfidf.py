"""TF-IDF of whole tables by chunks, against DuckDB."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parlance import catalog
from parlance.operators import tfidf


@pytest.mark.parametrize("name", ["tfidf_union", "tfidf_terms"])
def test_chunks_give_what_the_oracle_does_and_shuffle_no_postings(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(tfidf, "CHUNK", 2000)
    monkeypatch.setattr(tfidf, "CELLS", 500)
    r = random.Random(3)
    words = [r.choice("abcde") * r.randint(1, 3) + str(i % 37) * (i % 3) for i in range(150)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(150)], k=r.randint(1, 40)))) for i in range(120)]
    rows += [(5, "aaaa b aaaa c1 c1"), (5, None), (200, None), (201, ""), (202, "! ?"), (203, "a"), (204, "onlyhere nowhereelse"), (None, "aaaa b"), (205, "Ünïcode a1 A1 aaaaaa"), (206, "a1 " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "hashpartitioning(chunk" in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda x: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in row) for row in x), key=repr)
    want = con.execute(catalog.oracles()[name])
    assert [c[0] for c in want.description] == found.columns
    assert key(map(tuple, found.collect())) == key(want.fetchall())


def moved(spark) -> int:
    return sum(e.totalShuffleWrite() for e in list_of(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def list_of(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_what_moves_is_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tfidf, "CHUNK", 100_000)
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrd", k=r.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=100))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = moved(spark)
    assert len(catalog.queries()["tfidf_union"](spark, str(tmp_path)).collect()) == 2000
    assert 0 < moved(spark) - at < 4 * sum(len(t) for _, t in rows)


def test_terms_are_dealt_alike_whatever_their_order_even_where_hashes_meet(monkeypatch):
    terms = [f"{'x' * (i % 5)}{i} y" for i in range(2000)] + ["a" * 100_000]
    other = random.Random(1).sample(terms, len(terms))
    dealt = lambda t: ([t[i] for i in tfidf._dealt(pa.array(t), 7)[0]], tfidf._dealt(pa.array(t), 7)[1].tolist())
    assert dealt(terms) == dealt(other) and len(set(tfidf._hashed(pa.array(terms)).tolist())) == len(terms) and dealt(terms)[1][-1] == len(terms)
    assert min(b - a for a, b in zip(dealt(terms)[1], dealt(terms)[1][1:])) > 200
    assert tfidf._hashed(pa.array(terms).slice(70)).tolist() == tfidf._hashed(pa.array(terms)).tolist()[70:]
    plain = tfidf._hashed
    monkeypatch.setattr(tfidf, "_hashed", lambda t: plain(t) & np.uint64(7 << 61))
    assert dealt(terms) == dealt(other)


def test_terms_are_words_and_pairs_without_accents(spark, tmp_path):
    from math import log, sqrt

    texts = {1: "Café CRÈME brûlée, x 1", 2: "cafe creme BRULEE", 3: "Ñandú über_a naïve", 4: "nandu uber_a naive ΟΔΟΣ", 5: "été ΟΔΟΣ été", 6: "? x", 7: None, 8: "日本語 café crème", 9: "日本語"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    said = {1: "cafe creme brulee", 2: "cafe creme brulee", 3: "nandu uber_a naive", 4: "nandu uber_a naive οδοσ", 5: "ete οδοσ ete", 8: "日本語 cafe creme", 9: "日本語"}
    tf = {i: [*(w := t.split()), *map(" ".join, zip(w, w[1:]))] for i, t in said.items()}
    df = {g: sum(g in t for t in tf.values()) for t in tf.values() for g in t}
    want = {(i, g): (1 + log(t.count(g))) * (log(8 / (1 + df[g])) + 1) for i, t in tf.items() for g in t if df[g] >= 2}
    found = {(r.id, r.term): r.weight for r in catalog.queries()["tfidf_terms"](spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys() and (1, "cafe creme") in found and (4, "uber_a naive") in found
    for (i, g), w in want.items():
        assert found[i, g] == pytest.approx(w / sqrt(sum(x * x for (j, _), x in want.items() if j == i)), abs=2e-6)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {(i, g): w for i, g, w in con.execute(catalog.oracles()["tfidf_terms"]).fetchall()} == pytest.approx(found, abs=2e-6)
