import random
import re

from pyspark.sql import functions as F

from parlance.llm import decontaminate, ngram_join, rabitq, sharding
from tests.llm.common import ODD, docs


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    find = {i: i for i, _ in sets if i is not None}

    def top(i):
        while find[i] != i:
            i = find[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((top(i), top(j)))
                find[q] = p
    return sorted((str(i), len(x), str(None if i is None else top(i))) for i, x in sets)


def family(r, n, size, edits):
    """Near copies of one text, each with up to so many words changed."""
    base = [f"w{r.randrange(3000)}" for _ in range(size)]
    for _ in range(n):
        w = base[:]
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"e{r.randrange(10**6)}"
        yield " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    texts = [*family(r, 25, 60, 6), *family(r, 12, 150, 12), *family(r, 15, 12, 2), *family(r, 8, 5, 1)]
    shared = " ".join(f"licence{k}" for k in range(25))
    texts += [f"{' '.join(f'u{r.randrange(10**6)}' for _ in range(r.randint(3, 80)))} {shared}" for _ in range(25)]
    texts += texts[:6] + ["same words " * 40] * 3 + ["a", "a", "a b", "A  B"]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


def check(spark, rows, n, num, den):
    got = ngram_join.near_duplicates(docs(spark, rows), n, num, den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, n, num, den)


def test_components_match_brute_force(spark):
    for seed, n, num in ((1, 4, 85), (2, 5, 80)):
        check(spark, corpus(seed), n, num, 100)


def test_odd_rows_and_empty_table(spark):
    check(spark, [*ODD, (20, "five words are in here"), (21, "long " * 3000)], 4, 85, 100)
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_many_documents_that_share_one_passage(spark):
    """One boilerplate shingle in the prefixes of 5,000 documents that don't link, in cells, beside two that do."""
    r = random.Random(8)
    rows = [(i, f"the one shared passage u{r.randrange(10**9)}" if i % 2 else f"a{i} b{i} c{i} d{i} the one shared passage e{i}") for i in range(5000)]
    rows += [(6000, rows[8][1] + " more"), (6001, rows[8][1])]
    got = ngram_join.near_duplicates(docs(spark, rows), 4, 80, 100).where("component_id <> doc_id").collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(6000, 8), (6001, 8)]


def test_columns_that_clash(spark):
    rows = [(1, "some words that are here to stay for long"), (2, "some words that are here to stay for long"), (3, "others")]
    df = docs(spark, rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "n").withColumnRenamed("n_chars", "a.b")
    assert ngram_join.near_duplicates(df).where("component_id = 1").count() == 2
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 3]


def test_rows_that_share_an_id_keep_the_first_as_json(spark):
    rows = [(3, "text b of the two"), (3, "text a of the two"), (4, "other words in this row"), (4, "other words in this row")]
    assert sorted((x.doc_id, x.text) for x in ngram_join.keep_one(docs(spark, rows)).collect()) == [(3, "text a of the two"), (4, "other words in this row")]


def test_one_of_each_group_stays(spark):
    rows = [(1, "some words that are here to stay for long"), (2, "some words that are here to stay for long"), (3, "others"), (None, "others"), (3, "others"), (4, None), (5, "")]
    out = ngram_join.keep_one(docs(spark, rows))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "5", "None"] and out.columns == docs(spark, []).columns


def test_sharding(spark):
    rows = list(enumerate([f"own {k}" for k in range(300)] + ["hot"] * 200 + [f"pair {k % 60}" for k in range(180)] + [None, None, "", ""]))
    out = sharding.assign(docs(spark, rows), shards=8).cache()
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    where = {}
    for r in got:
        where.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t != "hot") and len(where["hot"]) <= 4
    few = sharding.assign(docs(spark, ODD), shards=40)
    assert few.count() == len(ODD) and few.where("slot <> 0").count() == 0
    assert sharding.assign(docs(spark, [])).count() == 0


def test_exact_and_near_passages(spark):
    r = random.Random(4)
    words = [f"t{r.randrange(40)}" for _ in range(60)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short Item"), (3, None), (4, "..."), (5, "the " * 12)], "item_id long, text string")
    rows = [
        (1, "before " + " ".join(words[10:35]) + " after"), (2, "a SHORT item, indeed; short item"), (3, " ".join(words[:9])), (4, "the " * 30), (5, None), (6, ""), (6, "!short item"),
        (7, " ".join(words[20:25] + ["x"] + words[25:30])), (None, "short-item"), (8, "end end end"),
    ]
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs(spark, rows), items).collect()}
    assert len(got) == len(rows)
    assert got[1, 27].n_hit == 25 and got[1, 27].n_items == 1 and got[2, 6].n_hit == 4 and got[3, 9].n_hit == 0 and got[4, 30].n_hit == 30
    assert got[5, 0].n_hit == got[6, 0].n_hit == 0 and got[6, 2].n_hit == 2 and got[7, 11].n_hit == 0 and got[None, 2].contaminated and not got[8, 3].contaminated
    near = decontaminate.Index(docs(spark, rows), items).proximity(2).select("key", "key2").distinct()
    assert near.count() >= 5
    kept = decontaminate.keep_clean(docs(spark, rows), items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "6", "7", "8"]
    assert decontaminate.contamination(docs(spark, []), items).count() == 0
    named = docs(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "_key").withColumnRenamed("n_chars", "wid")
    assert sorted(map(str, decontaminate.keep_clean(named, items).collect())) == sorted(str(r) for r in named.collect() if str(r.doc_id) in ("3", "5", "7", "8") or r.doc_id == 6 and not r.text)
    assert decontaminate.contamination(docs(spark, rows), items.limit(0)).where("contaminated").count() == 0


def test_long_texts_and_long_lists(spark, monkeypatch):
    """Occurrences across the pieces of a long text, with every list met."""
    monkeypatch.setattr(decontaminate, "LONG", 0)
    item = " ".join(f"t{k}" for k in range(14))
    items = spark.createDataFrame([(1, item), (2, "pair here")], "item_id long, text string")
    own = lambda n: "x y " * n
    rows = [(1, own(497) + item + " " + own(3000) + "pair here"), (2, own(500) + item), (3, own(4000) + "pair, but not here")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs(spark, rows), items).collect()}
    assert got == {1: (7010, 16, 2), 2: (1014, 14, 1), 3: (8004, 0, 0)}


def test_nearest_neighbours(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, 2.0]), (980, [None] + [1.0] * 15), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for row in rabitq.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == list(range(0, 600, 20))
    every, names = np.concatenate([x, x[7:8]]).astype(np.float64), np.append(np.arange(600), 7)
    hit = 0
    for q, found in got.items():
        s = every @ every[q]
        s[q] = -np.inf
        want = set(np.lexsort((names, -s))[:20].tolist())
        hit += len({v for _, v, _ in found} & {int(names[k]) for k in want})
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(score - float(every[v] @ every[q])) < 1e-9 for _, v, score in found)
    assert hit >= 0.9 * 20 * len(got)
    assert rabitq.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert rabitq.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).count() == 2


def exact(spark, table, k=20):
    """The oracle: every query against every row, in SQL that DuckDB runs."""
    import duckdb

    return duckdb.sql(f"""SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r
      FROM '{table}' q JOIN '{table}' c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE r <= {k}""").fetchall()


def test_recall_of_all_queries_of_the_tables(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    got = rabitq.nearest(spark.read.parquet(path), F.col("vec_id") % 20 == 0).collect()
    want = {(q, v): s for q, v, s in exact(spark, path)}
    assert len(got) == len(want)
    hit = [(r.query_id, r.vec_id) in want for r in got]
    assert sum(hit) >= 0.92 * len(want)
    assert all(abs(r.score - want[r.query_id, r.vec_id]) < 1e-6 for r in got if (r.query_id, r.vec_id) in want)


def test_vectors_of_any_size_and_repeated_ids(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.standard_normal((300, 12)) * 10.0 ** r.integers(-40, 41, (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, (-x[20]).tolist())] * 5 + [(1000, [3.0] + [0.0] * 11)] * 200
    first = None
    for shuffle in (0, 1):
        df = spark.createDataFrame(rows[::-1] if shuffle else rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS cell", "vec_id AS rank").repartition(3 + shuffle)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rabitq.nearest(df, F.col("vec_id") % 20 == 0).collect())
        assert sorted({g[0] for g in got}) == [*range(0, 300, 20), 1000] and len(got) == 20 * 16
        assert all(q != v for q, _, v, _ in got)
        first = first or got
        assert got == first
    every, names = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    ask = {q: min(v for i, v in rows if i == q) for q in {g[0] for g in first}}
    hit = total = 0
    for q, v in ask.items():
        s = np.where(names == q, -np.inf, every @ np.array(v))
        want = set(names[np.lexsort((names, -s))[:20]].tolist())
        hit, total = hit + len({g[2] for g in first if g[0] == q} & want), total + len(want)
    assert hit >= 0.9 * total
