"""Lexical and dense retrieval, rank fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import DUCK, SPARK
from parlance.functions.unicode import plain_words
from parlance.operators import bm25 as bm25_index
from parlance.operators import hybrid as fuse
from parlance.operators import textvec, tfidf
from parlance.operators.dense import nearest
from parlance.operators.guards import none_held
from parlance.operators.tables import once, stamp
from parlance.plans.common import PHRASES, both, brand, messages, run_sql
from parlance.plans.decisions import cascade
from parlance.plans.metrics import D, ordinal
from parlance.session import ship, table

DEPTH = 3 * P.TOP_N


#: The first 70 in 100 documents by id are the corpus, the rest the dev and test splits.
CUT = "(SELECT floor((max(doc_id) + 1) * 0.7) FROM documents)"


def bm25(d, asked: str = "SELECT item_id AS qid, text FROM benchmark", where: str = "") -> str:
    """s(qid, id, score): BM25 of each text of asked(qid, text) against the documents that share a term with it, term by term. The oracle's form; the engine searches the stored index."""
    k1, b, eps = D("1.5"), D("0.75"), D("0.25")
    return f"""dt AS (SELECT doc_id AS id, {d.explode(T.terms(d, 'text'))} AS term FROM documents WHERE doc_id IS NOT NULL {where}),
qt AS (SELECT qid, term, count(*) AS q FROM (SELECT qid, {d.explode(T.terms(d, 'text'))} AS term FROM ({asked}) a) u GROUP BY qid, term),
tf AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY id, term), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
st AS (SELECT {D('count(*)')} AS n, avg({D('dl')}) AS avgdl FROM dl), df AS (SELECT term, {D('count(*)')} AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), mean AS (SELECT avg(idf) AS m FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN {eps} * m ELSE idf END AS idf FROM raw, mean),
s AS (SELECT qt.qid, tf.id, sum(qt.q * idf.idf * tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - {b} + {b} * dl.dl / st.avgdl))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN idf ON idf.term = qt.term JOIN dl ON dl.id = tf.id CROSS JOIN st GROUP BY qt.qid, tf.id)"""


def stored(spark: SparkSession, sf_dir: str, split: bool = False) -> dict:
    """The index of all documents, or of the corpus split; built once for all queries of an application."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if split:
        docs = docs.where(F.col("doc_id") < F.lit(int(((docs.agg(F.max("doc_id").alias("m")).first()["m"] or 0) + 1) * 0.7)))
    key = (stamp(spark, f"{sf_dir.rstrip('/')}/documents.parquet"), split)
    return bm25_index.index(docs, key) | {"key": key}


def stored_vectors(spark: SparkSession, found: dict) -> DataFrame:
    """The vectors of the documents of an index, made once too."""
    return once(spark, ("vectors", *found["key"]), lambda: {"vectors": textvec.of_index(found["inverted"], found["terms"], found["n"])})["vectors"]


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def text_vectors(d) -> str:
    """vec(kind, id, dim, x): vectors of documents (d) and queries (q) by the terms of bm25(), components other than zero."""
    at, x = textvec.drawn(d, "term", "k")
    return f"""pr AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf, {at} AS dim, {x} AS x FROM df CROSS JOIN st CROSS JOIN (SELECT {d.explode(d.range('0', str(textvec.EACH - 1)))} AS k) ks WHERE df >= {textvec.MIN_DF}),
tx AS (SELECT kind, c.id, p.dim, sum((1 + ln({D('c.tf')})) * p.idf * p.x) AS x FROM (SELECT 'd' AS kind, id, term, tf FROM tf UNION ALL SELECT 'q', qid, term, q FROM qt WHERE qid IS NOT NULL) c JOIN pr p ON c.term = p.term GROUP BY kind, c.id, p.dim),
vec AS (SELECT tx.kind, tx.id, tx.dim, tx.x / l.l AS x FROM tx JOIN (SELECT kind, id, sqrt(sum(x * x)) AS l FROM tx GROUP BY kind, id) l ON tx.kind = l.kind AND tx.id = l.id WHERE l.l > 0)"""


@query("text_vectors", f"WITH {bm25(DUCK)}, {text_vectors(DUCK)} SELECT id, CAST(dim AS INT) AS dim, round(x, 6) + 0 AS x FROM vec WHERE kind = 'd' AND abs(x) > 1e-9")
def _(spark, sf_dir):
    found = stored(spark, sf_dir)
    rows = textvec.of_index(found["inverted"], found["terms"], found["n"]).select("id", F.posexplode("embedding").alias("dim", "x")).where(F.abs("x") > 1e-9)
    return rows.select("id", "dim", (F.round("x", 6) + F.lit(0.0)).alias("x"))


def top(source: str, k: int) -> str:
    return f"SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM {source}) r WHERE rank < {k}"


def dense(d) -> str:
    """v(qid, id, score): inner products of the last 30 in 100 vectors, the dev and test splits, with the first 70, the corpus. The oracle's form; the engine compares blocks."""
    return f"""n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), c AS (SELECT vec_id AS id, embedding, label FROM embeddings, n WHERE vec_id < floor(n * 0.7)), q AS (SELECT vec_id AS qid, embedding AS qe, label AS ql FROM embeddings, n WHERE vec_id >= floor(n * 0.7)),
v AS (SELECT q.qid, c.id, {d.dot('q.qe', 'c.embedding')} AS score, q.ql, c.label FROM q CROSS JOIN c)"""


@query("bm25_scores", f"WITH {bm25(DUCK)} SELECT qid, id, round(score, 4) AS score FROM s")
def _(spark, sf_dir):
    return bm25_index.scores(stored(spark, sf_dir), passages(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query("bm25_topk", f"WITH {bm25(DUCK)} SELECT qid, id, rank, round(score, 4) AS score FROM ({top('s', DEPTH)}) t")
def _(spark, sf_dir):
    return bm25_index.search(stored(spark, sf_dir), passages(spark, sf_dir), DEPTH).select("qid", "id", "rank", F.round("score", 4).alias("score"))


@query("bm25_top1", f"WITH {bm25(DUCK)} SELECT qid, id, round(least({D('1')}, score / 25), 6) AS confidence FROM ({top('s', 1)}) t WHERE score > 0")
def _(spark, sf_dir):
    return bm25_index.search(stored(spark, sf_dir), passages(spark, sf_dir), 1).where("score > 0").select("qid", "id", F.round(F.least(F.lit(1.0), F.col("score") / 25), 6).alias("confidence"))


def dense_hits(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest corpus vectors of each query vector, and the table of vectors."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    cut = F.lit(int(((table.agg(F.max("vec_id").alias("m")).first()["m"] or 0) + 1) * 0.7))
    rows = table.select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") >= cut), rows.where(F.col("vec_id") < cut), k), table


@query("dense_topk", f"WITH {dense(DUCK)} SELECT qid, id, rank, round(score, 6) AS score FROM ({top('v', DEPTH)}) t")
def _(spark, sf_dir):
    return dense_hits(spark, sf_dir, DEPTH)[0].select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("channel_ranks", f"WITH {dense(DUCK)} SELECT qid, id, rank FROM ({top('v', 10)}) t")
def _(spark, sf_dir):
    return dense_hits(spark, sf_dir, 10)[0].select("qid", "id", "rank")


def fused(d, asked: str = "SELECT item_id AS qid, text FROM benchmark", where: str = "") -> str:
    """f(qid, id, bm25_rank, dense_rank, rrf): both channels, near(qid, id, score) the inner products of text vectors. The oracle's form."""
    return f"""{bm25(d, asked, where)}, {text_vectors(d)}, lex AS ({top('s', DEPTH)}),
near AS (SELECT q.id AS qid, c.id, sum(q.x * c.x) AS score FROM vec q JOIN vec c ON q.kind = 'q' AND c.kind = 'd' AND q.dim = c.dim GROUP BY q.id, c.id), den AS ({top('near', DEPTH)}),
f AS (SELECT coalesce(l.qid, e.qid) AS qid, coalesce(l.id, e.id) AS id, l.rank AS bm25_rank, e.rank AS dense_rank,
  coalesce({D('1')} / ({P.RRF_K} + l.rank), 0) + coalesce({D('1')} / ({P.RRF_K} + e.rank), 0) AS rrf FROM lex l FULL OUTER JOIN den e ON l.qid = e.qid AND l.id = e.id)"""


def hybrid(d, asked: str = "SELECT item_id AS qid, text FROM benchmark", where: str = "") -> str:
    """z(qid, id, final, rank): the fused list ranked again by how well the document's reply resolves and how recent it is. The oracle's form."""
    return f"""{fused(d, asked, where)}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, id) AS k FROM f) x WHERE k <= {P.TOP_N}), {facts(d, where)},
g AS (SELECT a.qid, a.id, rrf * 1000 + 0.35 * least(fa.res_score, 6) + 0.25 * fa.recency AS final FROM a JOIN fa ON a.id = fa.id),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, id) AS rank FROM g) y WHERE rank <= {P.TOP_K})"""


def facts(d, where: str = "") -> str:
    """fa(id, reply, res_score, recency): each document's reply, how well it resolves, and its place between the first id and the last."""
    return f"""{messages(d)}, sc AS ({T.score_reply(d, 'reply', 'm', 'id, reply')}), ex AS (SELECT max(doc_id) AS hi, min(doc_id) AS lo FROM documents WHERE doc_id IS NOT NULL {where}),
fa AS (SELECT sc.id, sc.reply, sc.score AS res_score, {D('sc.id - ex.lo')} / greatest(ex.hi - ex.lo, 1) AS recency FROM sc CROSS JOIN ex)"""


def dense_channel(found: dict, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k documents nearest to each of asked(qid, text), and the vectors of asked."""
    own = textvec.vectors(textvec.counted(asked), found["terms"], found["n"])
    return nearest(own, stored_vectors(asked.sparkSession, found), k), own


def both_channels(spark: SparkSession, found: dict, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fused list of both channels for asked(qid, text), and the vectors of asked."""
    den, own = dense_channel(found, asked, DEPTH)
    return fuse.fused(bm25_index.search(found, asked, DEPTH), den), own


def hybrid_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, split: bool = False) -> DataFrame:
    """(qid, id, rrf, final, rank, sim): the hits of hybrid search among all documents or the corpus split, with the inner product of the vectors."""
    found = stored(spark, sf_dir, split)
    rows, own = both_channels(spark, found, asked)
    ranked = fuse.reranked(rows, run_sql(spark, sf_dir, f"WITH {facts(SPARK, f'AND doc_id < {CUT}' if split else '')} SELECT id, res_score, recency FROM fa"))
    pair = ranked.join(own.toDF("qid", "a"), "qid", "left").join(stored_vectors(spark, found).toDF("id", "b"), "id", "left")
    return pair.withColumn("sim", F.coalesce(F.expr(SPARK.dot("a", "b")), F.lit(0.0))).drop("a", "b")


@query("rrf_fuse", f"WITH {fused(DUCK)} SELECT qid, id, coalesce(bm25_rank, -1) AS bm25_rank, coalesce(dense_rank, -1) AS dense_rank, round(rrf, 9) AS rrf FROM f")
def _(spark, sf_dir):
    rows, _ = both_channels(spark, stored(spark, sf_dir), passages(spark, sf_dir))
    return rows.select("qid", "id", F.coalesce("bm25_rank", F.lit(-1)).alias("bm25_rank"), F.coalesce("dense_rank", F.lit(-1)).alias("dense_rank"), F.round("rrf", 9).alias("rrf"))


@query("hybrid_search", f"WITH {hybrid(DUCK)} SELECT qid, id, round(final, 6) AS final, rank FROM z")
def _(spark, sf_dir):
    return hybrid_hits(spark, sf_dir, passages(spark, sf_dir)).select("qid", "id", F.round("final", 6).alias("final"), "rank")


@query("max_similarity", f"WITH {dense(DUCK)} SELECT qid, round(coalesce(max(score), 0), 6) AS max_sim FROM v GROUP BY qid")
def _(spark, sf_dir):
    return dense_hits(spark, sf_dir, 1)[0].select("qid", F.round("score", 6).alias("max_sim"))


@query("nearest_label", f"""WITH {dense(DUCK)}, b AS (SELECT qid, ql, label, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS r FROM v) x WHERE r = 1)
SELECT ql AS gold, label AS pred, count(*) AS n, round(avg(score), 6) AS confidence FROM b GROUP BY ql, label""")
def _(spark, sf_dir):
    hits, table = dense_hits(spark, sf_dir, 1)
    gold, pred = table.select(F.col("vec_id").alias("qid"), F.col("label").alias("gold")), table.select(F.col("vec_id").alias("id"), F.col("label").alias("pred"))
    return hits.join(gold, "qid").join(pred, "id").groupBy("gold", "pred").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("confidence"))


def leaks(d) -> str:
    """l(qid, id): retrieved documents that belong to the dev or test split, the last 30 in 100 by id."""
    return f"{bm25(d)}, c AS (SELECT floor((max(doc_id) + 1) * 0.7) AS c FROM documents), l AS (SELECT qid, id FROM ({top('s', P.TOP_N)}) t CROSS JOIN c WHERE id >= c.c)"


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").agg(F.floor((F.max("doc_id") + 1) * 0.7).alias("c"))
    hits = bm25_index.search(stored(spark, sf_dir), passages(spark, sf_dir), P.TOP_N)
    return hits.crossJoin(F.broadcast(cut)).where("id >= c").select("qid", "id")  # one row


@query("leakage_check", f"WITH {leaks(DUCK)} SELECT qid, id FROM l")
def _(spark, sf_dir):
    return leaked(spark, sf_dir)


@query("leakage_summary", f"WITH {leaks(DUCK)} SELECT count(*) AS hits, count(DISTINCT id) AS leaked, min(id) AS first_id FROM l")
def _(spark, sf_dir):
    return leaked(spark, sf_dir).agg(F.count("*").alias("hits"), F.count_distinct("id").alias("leaked"), F.min("id").alias("first_id"))


@both("ngram_overlap")
def _(d):
    every = d.map(d.range("0", f"greatest({d.size('w')} - 13, 0)"), "i", d.join("slice(w, CAST(i AS INT) + 1, 13)" if d.name == "spark" else "w[i + 1 : i + 13]", " "))
    return f"""WITH b AS (SELECT DISTINCT {d.explode(every)} AS g FROM (SELECT {T.terms(d, 'text')} AS w FROM benchmark) x WHERE {d.size('w')} >= 13), t AS (SELECT doc_id, {d.explode(every)} AS g FROM (SELECT doc_id, {T.terms(d, 'text')} AS w FROM documents) y WHERE {d.size('w')} >= 13)
SELECT DISTINCT doc_id FROM t WHERE g IN (SELECT g FROM b)"""


@both("centroid_nearest")
def _(d):
    spread = "LATERAL VIEW posexplode(embedding) p AS i, x" if d.name == "spark" else ""
    e = f"SELECT vec_id, label, i, {D('x')} AS x FROM embeddings {spread}" if d.name == "spark" else f"SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, {D('unnest(embedding)')} AS x FROM embeddings"
    return f"""WITH e AS ({e}), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), s AS (SELECT e.label, e.vec_id, sum(e.x * c.m) AS score FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY e.label, e.vec_id)
SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) r WHERE rank <= 20"""


def pairs(d) -> str:
    """Each two neighbours of the list w."""
    item = (lambda a, i: f"{a}[CAST({i} AS INT)]") if d.name == "spark" else (lambda a, i: f"{a}[{i} + 1]")
    return d.map(d.range("0", f"greatest({d.size('w')} - 2, 0)"), "i", f"concat({item('w', 'i')}, ' ', {item('w', 'i + 1')})")


def tfidf_terms(d) -> str:
    """Sublinear weights, scaled to length 1, of the words of two characters or more and the word pairs of two texts or more, accents stripped. The oracle's form: Spark has no strip_accents."""
    words = d.find_all("strip_accents(lower(text))", r"[\p{L}\p{N}_]{2,}")
    return f"""WITH x AS (SELECT doc_id AS id, {words} AS w FROM documents WHERE doc_id IS NOT NULL), t AS (SELECT id, {d.explode('w')} AS term FROM x UNION ALL SELECT id, {d.explode(pairs(d))} FROM x WHERE {d.size('w')} >= 2), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT {D('count(DISTINCT id)')} AS n FROM tf),
w AS (SELECT tf.id, tf.term, (1 + ln({D('tf')})) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term CROSS JOIN n)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w"""


@query("tfidf_terms", tfidf_terms(DUCK))
def _(spark, sf_dir):
    ship(spark)
    docs, words = table(spark, sf_dir, "documents").select("doc_id", "text"), plain_words(F.col("text"))
    n = docs.where("doc_id is not null").select("doc_id", words.alias("words")).where("words <> ''").select("doc_id").distinct().count()
    return tfidf.weighed(docs, {"word": 2}, n, tfidf.Weights(), words).select("id", "term", F.round("weight", 6).alias("weight"))


@both("cluster_profile")
def _(d):
    """Of each cluster its size, the 20 vectors nearest to its mean and 10 seeded ones of the rest."""
    spread = f"SELECT vec_id, label, i, {D('x')} AS x FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, x" if d.name == "spark" else f"SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, {D('unnest(embedding)')} AS x FROM embeddings"
    seed = d.hex32(f"concat({d.text('vec_id')}, '-20260909')")
    return f"""WITH e AS ({spread}), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), s AS (SELECT e.label, e.vec_id, sum(e.x * c.m) AS score FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY e.label, e.vec_id),
n AS (SELECT label, count(*) AS size FROM s GROUP BY label), near AS (SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS place FROM s) r WHERE place <= 20),
other AS (SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {seed}, vec_id) AS place FROM (SELECT s.label, s.vec_id FROM s LEFT JOIN near ON s.vec_id = near.vec_id AND s.label = near.label WHERE near.vec_id IS NULL) t) r WHERE place <= 10)
SELECT p.label, n.size, p.kind, p.place, p.vec_id FROM (SELECT label, 'near' AS kind, place, vec_id FROM near UNION ALL SELECT label, 'random', place, vec_id FROM other) p JOIN n ON p.label = n.label"""


def b1(d, hits: str) -> str:
    """The best match of each passage by BM25, its text as reply up to the limit, and the keyword rules; without a match no reply. hits has t(qid, id, score)."""
    return f"""WITH {hits}, k AS (SELECT item_id, {T.first_rule(d, 'text', P.KEYWORD_RULES)} AS code FROM benchmark)
SELECT k.item_id AS qid, t.id AS retrieved, coalesce(substr(r.text, 1, {P.REPLY_CHARS}), '') AS reply, t.id IS NOT NULL AS used_retrieval, round(coalesce(least({D('1')}, t.score / 25), 0), 6) AS max_sim,
  CASE WHEN k.code IS NULL THEN 'auto' ELSE 'escalate' END AS route, coalesce(k.code, 'known_troubleshooting_flow') AS code, CASE WHEN k.code IS NULL THEN {D('0.5')} ELSE {D('1')} END AS confidence
FROM k LEFT JOIN t ON k.item_id = t.qid LEFT JOIN documents r ON r.doc_id = t.id"""


@query("baseline_b1", b1(DUCK, f"{bm25(DUCK)}, t AS (SELECT qid, id, score FROM ({top('s', 1)}) z WHERE score > 0)"))
def _(spark, sf_dir):
    bm25_index.search(stored(spark, sf_dir), passages(spark, sf_dir), 1).where("score > 0").createOrReplaceTempView("first_hits")
    return run_sql(spark, sf_dir, b1(SPARK, "t AS (SELECT qid, id, score FROM first_hits)"))


def asked_of_agent(d) -> str:
    """(qid, text): a message for each passage of the benchmark, of a support sentence and the passage."""
    return f"SELECT item_id AS qid, concat({d.at(brand(d), f'item_id % {len(PHRASES)} + 1')}, ' ', text) AS text FROM benchmark WHERE item_id IS NOT NULL"


def handle(d, hits: str) -> str:
    """Every message through all steps. hits has z(qid, id, rank, sim), hits of the corpus split that the guard let through, and fa(id, reply).

    The class is that of the first keyword probe that matches, surer the fewer do; the draft is the reply of the best hit, within its limit,
    and a fixed sentence where there is no hit or the model's answer can't be read; the cascade decides on both."""
    families = [d.like("text", p) for p in P.PROBES.values()]
    met = " + ".join(f"CAST({f} AS INT)" for f in families)
    source = f"""{hits}, hl AS (SELECT qid, max(sim) AS max_sim, {d.join(d.collect(d.text('id'), 'rank'), ',')} AS retrieved, min(CASE WHEN rank = 1 THEN id END) AS best FROM z GROUP BY qid),
m AS (SELECT b.qid AS id, b.text, FALSE AS has_context, '' AS context, coalesce(hl.max_sim, 0) AS max_sim, coalesce(hl.retrieved, '') AS retrieved, fa.reply, hl.best FROM ({asked_of_agent(d)}) b LEFT JOIN hl ON b.qid = hl.qid LEFT JOIN fa ON hl.best = fa.id)"""
    auto = ordinal("code", P.AUTO_CODES)
    used = "c.parsed AND m.best IS NOT NULL AND m.reply <> ''"
    return f"""WITH {cascade(d, source=source, sim='round(max_sim, 6)', intent=T.first_rule(d, 'text', list(P.PROBES.items()), "'other'"), confidence=f"{D('1')} / greatest({met}, 1) * CASE WHEN {met} = 0 THEN 0.5 ELSE 1 END")}
SELECT c.id, c.intent, round(c.confidence, 6) AS confidence, CASE WHEN {used} THEN {T.truncate_reply(d, 'm.reply')} ELSE {d.lit(P.HANDED_ON)} END AS reply, m.retrieved, CASE WHEN {used} THEN {d.text('m.best')} ELSE '' END AS grounded_in, {used} AS used_retrieval,
  round(c.sim, 4) AS max_sim, CASE WHEN {auto} THEN 'auto' ELSE 'escalate' END AS route, code, layer FROM c JOIN m ON c.id = m.id"""


HELD = f"AND doc_id < {CUT}"
_SIM = "p AS (SELECT z.qid, z.id, z.rank, coalesce(near.score, 0) AS sim FROM z LEFT JOIN near ON z.qid = near.qid AND z.id = near.id)"


@query("agent_handle", handle(DUCK, f"h0 AS (WITH {hybrid(DUCK, asked_of_agent(DUCK), HELD)}, {_SIM} SELECT p.*, fa.reply FROM p JOIN fa ON p.id = fa.id), z AS (SELECT qid, id, rank, sim FROM h0), fa AS (SELECT DISTINCT id, reply FROM h0)"))
def agent_handle(spark, sf_dir):
    """Search of the corpus split by both channels, the guard in the plan, class, draft from the hits, and the cascade."""
    return handled(spark, sf_dir, hybrid_hits(spark, sf_dir, run_sql(spark, sf_dir, asked_of_agent(SPARK)), split=True))


def handled(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """The messages with these hits; the job stops if one is of the dev or test split."""
    held = run_sql(spark, sf_dir, f"SELECT doc_id AS id FROM documents WHERE doc_id >= {CUT}")
    none_held(hits.select("qid", "id", "rank", "sim"), held).createOrReplaceTempView("agent_hits")
    replies = f"fa AS (SELECT f.id, f.reply FROM (WITH {facts(SPARK)} SELECT id, reply FROM fa) f LEFT SEMI JOIN agent_hits h ON f.id = h.id)"
    return run_sql(spark, sf_dir, handle(SPARK, f"z AS (SELECT * FROM agent_hits), {replies}"))


def tfidf_union(d) -> str:
    """Sublinear weights of words and word pairs of two texts or more, and of 3 to 5 characters within blank-padded words of three texts or more, each half scaled to length 1."""
    sub = (lambda a, i, n: f"substr({a}, CAST({i} AS INT), {n})") if d.name == "spark" else (lambda a, i, n: f"substr({a}, {i}, {n})")
    grams = " UNION ALL ".join(f"SELECT id, tf, {d.explode(d.map(d.range('1', f'greatest(length(p) - {n} + 1, 1)'), 'i', sub('p', 'i', n)))} AS term FROM c WHERE length(p) >= {n} OR {n} = 3" for n in (3, 4, 5))
    words = d.filter(T.terms(d, "text"), "v", "length(v) >= 2")
    half = lambda k, least: f"""{k}f AS (SELECT id, term, sum(tf) AS tf FROM {k}t GROUP BY id, term), {k}d AS (SELECT term, count(*) AS df FROM {k}f GROUP BY term HAVING count(*) >= {least}),
{k}w AS (SELECT f.id, f.term, (1 + ln({D('f.tf')})) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {k}f f JOIN {k}d e ON f.term = e.term CROSS JOIN n)"""  # noqa: E731
    out = lambda k, name: f"SELECT id, '{name}' AS half, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS total, round(max(w) / sqrt(sum(w * w)), 6) AS highest FROM {k}w GROUP BY id"
    return f"""WITH t AS (SELECT doc_id AS id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), n AS (SELECT {D('count(*)')} AS n FROM t),
wt AS (SELECT id, 1 AS tf, {d.explode('w')} AS term FROM t UNION ALL SELECT id, 1, {d.explode(pairs(d))} FROM t WHERE {d.size('w')} >= 2),
c AS (SELECT id, concat(' ', v, ' ') AS p, count(*) AS tf FROM (SELECT doc_id AS id, {d.explode(T.terms(d, 'text'))} AS v FROM documents WHERE doc_id IS NOT NULL) z GROUP BY id, v), ct AS ({grams}),
{half('w', 2)}, {half('c', 3)} {out('w', 'word')} UNION ALL {out('c', 'char')}"""


@query("tfidf_union", tfidf_union(DUCK))
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null and text is not null")
    return tfidf.weighed(docs, {"word": 2, "char": 3}, docs.count(), tfidf.Sums()).select("id", "half", "terms", F.round("total", 6).alias("total"), F.round("highest", 6).alias("highest"))
