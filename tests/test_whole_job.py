"""Queries held against plain Python that reads every row and whole texts, where an oracle would share a cut with its query."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from parlance import catalog
from parlance.functions.dialect import DUCK, SPARK
from parlance.plans.common import PHRASES, messages, run_sql
from parlance.plans.retrieval import DEPTH

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def text_vector(counts, df, n):
    """TF-IDF under the projection that md5 draws, a term at a time."""
    out = np.zeros(64)
    for term, tf in counts.items():
        if df.get(term, 0) >= 2:
            for k in range(4):
                h = int(hashlib.md5(f"{term}-{k}".encode()).hexdigest()[:8], 16)
                out[h % 64] += (1 if h % 128 < 64 else -1) * 0.5 * (1 + np.log(tf)) * (1 + np.log((1 + n) / (1 + df[term])))
    return out / (np.linalg.norm(out) or 1)


def test_dense_channel_compares_every_document(spark):
    got = defaultdict(dict)
    for r in catalog.queries()["rrf_fuse"](spark, SF).where("dense_rank >= 0").collect():
        got[r.qid][r.dense_rank] = r.id
    terms = lambda text: Counter(re.findall("[a-z0-9]+", text.lower()))
    docs = {r.doc_id: terms(r.text) for r in table(spark, "documents") if re.search("[a-z0-9]", r.text.lower())}
    df = Counter(t for c in docs.values() for t in c)
    ids = sorted(docs)
    x = np.stack([text_vector(docs[i], df, len(docs)) for i in ids])
    for b in table(spark, "benchmark"):
        score = np.round(x @ text_vector(terms(b.text), df, len(docs)), 9)
        order = [ids[k] for k in np.lexsort((ids, -score))]
        assert [got[b.item_id][k] for k in range(len(got[b.item_id]))] == order[:DEPTH]


def resampled(v):
    """Mean and the interval of 1000 resamples of v drawn by md5, which names places in the order of value."""
    v, n = np.sort(np.array(v, float)), len(v)
    draws = [[int(hashlib.md5(f"{b}-{i}-20260909".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(1000)]
    means = v[np.array(draws)].mean(axis=1)
    return v.mean(), *np.quantile(means, [0.025, 0.975]), (means < 0).mean()


def examples(spark):
    """(right, cost) of each document and system."""
    out = defaultdict(list)
    for i in sorted(r.doc_id for r in table(spark, "documents")):
        for s in range(4):
            gold, pred = i % 11, i % 11 if (i * 13 + s * 5) % 10 < 5 + s else (i * 3 + s) % 11
            must = i % 6 == 0
            did = must if (i * 17 + s) % 10 < 6 + s else i % 4 == 0
            out[s].append((gold == pred, 10 * (must and not did) + (did and not must)))
    return out


def test_bootstrap_draws_from_all_examples(spark):
    found = examples(spark)
    for r in catalog.queries()["bootstrap_ci"](spark, SF).collect():
        assert np.allclose((r.point, r.lo, r.hi), resampled([x for x, _ in found[r.system]])[:3], atol=2e-6)
    for r in catalog.queries()["paired_bootstrap"](spark, SF).collect():
        want = resampled([a - b for (_, a), (_, b) in zip(found[3], found[r.system], strict=True)])
        assert np.allclose((r.mean_diff, r.lo, r.hi, r.helps), want, atol=2e-6) and r.meaningful == (want[2] < 0)


def test_messages_hold_every_text(spark):
    got = {r.id: r.text for r in run_sql(spark, SF, f"WITH {messages(SPARK)} SELECT id, text FROM m").collect()}
    for r in table(spark, "documents"):
        assert got[r.doc_id] == PHRASES[r.doc_id % len(PHRASES)] + " " + re.sub(r"[^\x00-\x7F]", " ", r.text)


def test_short_messages(spark, tmp_path):
    """Documents of few words or none, which the tables lack, behind every phrase."""
    rows = [(i, ("", "ok", "a few more words")[i // 40], "en", "s", 0) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{SF}/pages.parquet", f"{tmp_path}/pages.parquet")  # a phrase holds the word
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("quality_reason", "hard_flags", "english_filter", "tokenize", "scrub_pii"):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog.oracles()[name]).fetchall())
        if name == "quality_reason":
            assert "too_short" in {r.reason for r in got.collect()}


LONG = "the account page keeps failing after every single update of the application on my phone "


def whole_texts(spark, path):
    """Documents 0 and 40 begin alike and differ at the end, 80 repeats 0; 5 and 45 have replies over 280 characters."""
    rows = [(0, LONG * 4 + "first"), (40, LONG * 4 + "second"), (80, LONG * 4 + "first"), (5, "x" * 700), (45, "y" * 1500), (1, "short")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    os.symlink(f"{SF}/pages.parquet", f"{path}/pages.parquet")  # a phrase holds the word
    return dict(rows)


def test_keys_and_replies_come_from_whole_texts(spark, tmp_path):
    texts = whole_texts(spark, tmp_path)
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in run("dedupe_first")) == [0, 1, 5, 40, 45]
    replies = ["" if i % 9 == 0 else t for i, t in texts.items()]
    for r in run("reply_checks"):
        assert r.mean_chars == round(sum(map(len, replies)) / len(replies), 6) and r.empties == replies.count("")


def test_must_include_compares_the_whole_text(spark, tmp_path):
    """The words of the reply to document 5 stand in its message only after 60 characters."""
    reply = PHRASES[(5 * 7 + 3) % len(PHRASES)]
    rows = [(5, "1 " * 40 + reply), (45, "nothing of that reply")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{SF}/pages.parquet", f"{tmp_path}/pages.parquet")
    got = {r.id: r for r in catalog.queries()["must_include"](spark, str(tmp_path)).collect()}
    assert got[5].violated and not got[45].violated


def test_leaks_off_any_grid_are_found(spark, tmp_path):
    item = [f"w{k}" for k in range(40)]
    rows = [(i, "before " + " ".join(item[i : i + 13]) + " after") for i in range(28)] + [(99, " ".join(item[:12]))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in catalog.queries()["ngram_overlap"](spark, str(tmp_path)).collect()) == list(range(28))


def test_allocation_meets_the_target_and_the_quota_is_kept(spark):
    from collections import Counter

    from parlance.functions import patterns as P

    rows = {r.doc_id: (P.INTENTS[r.doc_id % 11], r.doc_id % 5 == 0) for r in table(spark, "documents")}
    pool = Counter(i for i, _ in rows.values())
    take = {i: min(P.FLOOR, pool[i]) for i in P.INTENTS}
    left, room = P.TARGET - sum(take.values()), {i: pool[i] - take[i] for i in P.INTENTS}
    take = {i: min(pool[i], n + round(left * room[i] / sum(room.values()))) if sum(room.values()) else n for i, n in take.items()}
    while sum(take.values()) > P.TARGET:
        take[max(take, key=take.get)] -= 1
    while sum(take.values()) < min(P.TARGET, len(rows)):
        take[max((i for i in take if take[i] < pool[i]), key=lambda i: pool[i] - take[i])] += 1
    got = {r.intent: r["take"] for r in catalog.queries()["stratified_alloc"](spark, SF).collect()}
    assert got == {i: n for i, n in take.items() if pool[i]} and sum(got.values()) == min(P.TARGET, len(rows))
    picked = catalog.queries()["quota_pick"](spark, SF).collect()
    assert Counter(r.gold for r in picked) == {i: n for i, n in got.items() if n}
    for i, n in got.items():
        hard, easy = (sum(g == i and h == want for g, h in rows.values()) for want in (True, False))
        first = min(hard, max(1, round(n * P.HARD_QUOTA)))
        assert sum(r.gold == i and r.is_hard for r in picked) == min(hard, max(first, n - easy))


def test_shuffled_options_hold_every_intent(spark):
    from parlance.functions import patterns as P

    rows = catalog.queries()["label_pass"](spark, SF).collect()
    assert all(sorted(r.options.split(",")) == sorted(P.INTENTS) for r in rows)
    assert len({r.options for r in rows}) > len(rows) // 2 and {r.intent for r in rows if r.failed} == {"other"}


def test_characters_within_words(spark):
    from math import log, sqrt

    docs = [(r.doc_id, re.findall("[a-z0-9]+", r.text.lower())) for r in table(spark, "documents") if r.text is not None]
    tf, df = {}, defaultdict(int)
    for i, words in docs:
        tf[i] = defaultdict(int)
        for w in words:
            p = f" {w} "
            for n in (3, 4, 5):
                if len(p) >= n:
                    for k in range(len(p) - n + 1):
                        tf[i][p[k : k + n]] += 1
        for g in tf[i]:
            df[g] += 1
    got = {r.id: r for r in catalog.queries()["tfidf_union"](spark, SF).where("half = 'char'").collect()}
    for i, _ in docs:
        w = [(1 + log(n)) * (log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in tf[i].items() if df[g] >= 3]
        if w:
            assert got[i].terms == len(w) and np.isclose(got[i].total, sum(w) / sqrt(sum(x * x for x in w)), atol=1e-5)
        else:
            assert i not in got


def test_the_agent_answers_every_passage_from_the_corpus_split(spark):
    rows = {r.id: r for r in catalog.queries()["agent_handle"](spark, SF).collect()}
    assert set(rows) == {r.item_id for r in table(spark, "benchmark")}
    cut = int((max(r.doc_id for r in table(spark, "documents")) + 1) * 0.7)
    assert all(int(i) < cut for r in rows.values() if r.retrieved for i in r.retrieved.split(","))
    assert all(-1 <= r.max_sim <= 1 and len(r.reply) <= 281 and r.route in ("auto", "escalate") for r in rows.values())
    assert any(r.retrieved for r in rows.values())
