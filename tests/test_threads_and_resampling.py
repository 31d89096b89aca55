"""Threads from real ids by pointer jumping, and the bootstrap as an aggregate."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import graph, resample
from parlance.plans import threads

TWEETS = "tweet_id string, author_id string, inbound boolean, parent string, created_at long, text string"


def flat(spark, rows):
    """tweets and edges of (id, author, parent) rows; the brand's messages are outbound."""
    t = spark.createDataFrame([(i, a, a != "brand", p, k, f"text {i}") for k, (i, a, p) in enumerate(rows)], TWEETS).repartition(3)
    known = t.select(F.col("tweet_id").alias("parent"))
    e = t.where("parent <> tweet_id").select("parent", F.col("tweet_id").alias("child")).join(known, "parent", "left_semi").distinct()
    return t, e


def best(spark, rows):
    t, e = flat(spark, rows)
    got = {r.root: r.path for r in graph.best_lines(t, e, "brand").collect()}
    assert got == {r.root: r.path.split(" ") for r in graph.best_branches(t, e, "brand").collect()}  # the loop, a join a turn
    return got


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("1", "u", ""), ("2", "brand", "1"), ("3", "v", "1"), ("4", "w", "3"), ("5", "x", "4")], {"1": ["1", "2"]}),
        ([("1", "u", ""), ("2", "brand", "1"), ("4", "brand", "1"), ("5", "u", "4"), ("6", "brand", "5")], {"1": ["1", "4", "5", "6"]}),
        ([("98765", "u", ""), ("4000000001", "brand", "98765"), ("7", "u", "4000000001")], {"98765": ["98765", "4000000001", "7"]}),
        ([("1", "u", "999"), ("2", "brand", "1")], {"1": ["1", "2"]}),  # the parent is not there
        ([("1", "u", "1"), ("2", "brand", "1")], {"1": ["1", "2"]}),  # its own parent
        ([("1", "brand", ""), ("2", "u", "1")], {}),  # what the brand starts is no root
        ([("1", "u", "3"), ("2", "u", "1"), ("3", "u", "2"), ("9", "u", "")], {"9": ["9"]}),  # a circle
        ([("1", "u", ""), ("2", "v", "1"), ("3", "v", "1")], {"1": ["1", "3"]}),  # a tie goes to the larger path
        ([], {}),
    ],
)
def test_branches_by_hand(spark, rows, want):
    assert best(spark, rows) == want


def test_long_chains_end_at_twenty_turns(spark):
    chain = [(str(1000 + 7 * k), "brand" if k % 2 else "u", str(1000 + 7 * (k - 1)) if k else "") for k in range(59)]
    got = best(spark, [*chain, ("side", "u", "1000")])
    assert got == {"1000": [i for i, _, _ in chain[:20]]}


def test_random_forests(spark):
    r = np.random.default_rng(6)
    ids = [str(x) for x in r.choice(10**9, 400, replace=False)]
    rows = [(i, "brand" if r.random() < 0.3 else f"u{k % 9}", ids[r.integers(max(0, k - 30), k)] if k and r.random() < 0.93 else "") for k, i in enumerate(ids)]
    assert len(best(spark, rows)) > 3


def test_turns_of_threads_come_in_order(spark):
    t, e = flat(spark, [("50", "u", ""), ("7", "brand", "50"), ("900", "u", "7"), ("3", "u", "")])
    got = threads.threads(t, e).orderBy("root", "place").collect()
    assert [(r.root, r.place, r.tweet_id, r.text) for r in got] == [("50", 0, "50", "text 50"), ("50", 1, "7", "text 7"), ("50", 2, "900", "text 900")]


def groups(spark, **values):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"grp": g, "v": v, "one": 1.0}) for g, v in values.items()])).repartition(4)


MEAN = {"mean": "v / one"}


def test_intervals_bracket_the_point(spark):
    got = resample.intervals(groups(spark, a=[1.0] * 70 + [0.0] * 30, b=[2.5] * 40), ["v", "one"], MEAN).collect()
    a, b = sorted(got, key=lambda r: r.grp)
    assert math.isclose(a.point, 0.7) and a.lo <= a.point <= a.hi and 0.07 < a.half_width < 0.11
    assert (b.point, b.lo, b.hi) == (2.5, 2.5, 2.5)  # a constant has no spread
    assert sorted(got, key=lambda r: r.grp) == sorted(resample.intervals(groups(spark, a=[1.0] * 70 + [0.0] * 30, b=[2.5] * 40).repartition(7), ["v", "one"], MEAN).collect(), key=lambda r: r.grp)
    assert resample.intervals(groups(spark, a=[1.0]).limit(0), ["v", "one"], MEAN).count() == 0


@pytest.mark.parametrize("cells", [50_000, 60])
def test_replicates_are_those_of_the_plain_bootstrap(spark, monkeypatch, cells):
    """In one part and in many: every replicate has all examples, and means spread as when rows are drawn one by one."""
    monkeypatch.setattr(resample, "CELLS", cells)
    monkeypatch.setattr(resample, "HELD", 5000)
    v = np.random.default_rng(3).gamma(2.0, size=800)
    got = resample.replicates(groups(spark, a=v), ["v", "one"]).toPandas()
    assert len(got) == 1000 and set(got.one) == {800.0} and set(got.replicate) == set(range(1000))
    means = got.v / got.one
    r = np.random.default_rng(4)
    plain = np.array([v[r.integers(0, 800, 800)].mean() for _ in range(4000)])
    assert abs(means.mean() - v.mean()) < 4 * plain.std() / math.sqrt(1000)
    assert 0.9 < means.std() / plain.std() < 1.1
    for q in (0.025, 0.5, 0.975):
        assert abs(means.quantile(q) - np.quantile(plain, q)) < 0.25 * plain.std()


def test_macro_f1_of_replicates(spark):
    from parlance.plans.metrics import f1_states

    r = np.random.default_rng(9)
    gold, pred = r.choice(list("abc"), 300, p=[0.7, 0.2, 0.1]), r.choice(list("abc"), 300)
    pred = np.where(r.random(300) < 0.6, gold, pred)
    rows = spark.createDataFrame(pd.DataFrame({"grp": "s", "gold": gold, "pred": pred}))
    states, macro = f1_states(["a", "b", "c", "unused"])
    rows = rows.select("grp", *(F.expr(e).alias(n) for n, e in states.items()))
    got = resample.intervals(rows, list(states), {"macro_f1": macro}).first()

    def plain(g, p):
        f = [2 * ((g == c) & (p == c)).sum() / ((g == c).sum() + (p == c).sum()) for c in sorted(set(g))]
        return sum(f) / len(f)

    draws = [plain(gold[i], pred[i]) for i in (r.integers(0, 300, 300) for _ in range(2000))]
    assert math.isclose(got.point, plain(gold, pred)) and abs(got.lo - np.quantile(draws, 0.025)) < 0.02 and abs(got.hi - np.quantile(draws, 0.975)) < 0.02


@pytest.mark.parametrize("nameless", [False, True])
def test_roots_are_found_by_an_equi_join(spark, tmp_path, nameless):
    """A row without an id makes the IN of every parent that is not there null, so that only rows without doubt stay."""
    import duckdb

    from parlance import catalog

    rows = [(c, t, "user" if (c + t) % 2 == 0 else "assistant", f"text {t}") for c in range(9) for t in range(4)] + ([(None, 0, "user", "x")] if nameless else []) + [(3, None, "user", "y")]
    spark.createDataFrame(rows if nameless else rows[:-1], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.queries()["find_roots"](spark, str(tmp_path))
    assert "ExistenceJoin" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(r.tweet_id for r in found.collect()) == sorted(r[0] for r in con.execute(catalog.oracles()["find_roots"]).fetchall())


def test_draws_are_the_hashes_of_the_sql(spark, monkeypatch):
    import hashlib

    import numpy as np

    from parlance.plans import metrics

    for r, a, b in ((0, 0, 10), (7, 10, 99), (999, 99_998, 100_000), (12, 100_000, 100_200)):
        for x in {a: range(a, min(b, 10 ** len(str(a)))), b - 1: range(b - 1, b)}.values():
            want = [int(hashlib.md5(f"{r}-{j}-20260909".encode()).hexdigest()[:8], 16) for j in x]
            assert metrics.md5_heads(f"{r}-", np.array(x), "-20260909").tolist() == want
    whole = list(metrics._counted({1234: np.array([100, 1234])})([__import__("pandas").DataFrame({"n": [1234], "replicate": [5], "a": [0], "b": [1234]})]))[0]
    low = sum(int(hashlib.md5(f"5-{j}-20260909".encode()).hexdigest()[:8], 16) % 1234 < 100 for j in range(1234))
    assert whole.w.tolist() == [low, 1234 - low]
    monkeypatch.setattr(metrics, "DRAWS", 7)
    from parlance import catalog

    again = catalog.queries()["bootstrap_ci"](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.undo()
    assert sorted(again) == sorted(catalog.queries()["bootstrap_ci"](spark, "/root/testdata/sf0.001").collect())
