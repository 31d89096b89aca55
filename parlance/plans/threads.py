"""Threads from flat messages: edges, roots, neighbourhoods and best branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions.dialect import DUCK, SPARK
from parlance.operators import graph
from parlance.plans.common import both, edges, run_sql, tweets


@both("turn_lookup")
def _(d):
    return f"""WITH {tweets(d)}, u AS (SELECT *, 0 AS pos FROM t UNION ALL SELECT *, 1 AS pos FROM t WHERE turn % 3 = 1),
k AS (SELECT tweet_id, author_id, pos, row_number() OVER (PARTITION BY tweet_id ORDER BY pos DESC) AS r, min(pos) OVER (PARTITION BY tweet_id) AS first_pos FROM u)
SELECT tweet_id, author_id, first_pos FROM k WHERE r = 1"""


@both("edges_both_ways")
def _(d):
    return f"""WITH {tweets(d)}, {edges(d)}, listed AS (SELECT parent AS id, {d.join(d.collect('child', 'child'), ',')} AS children FROM e GROUP BY parent),
up AS (SELECT parent, tweet_id AS child FROM t WHERE parent <> '' AND turn % 2 = 0),
down AS (SELECT id AS parent, {d.explode("split(children, ',')" if d.name == 'spark' else "string_split(children, ',')")} AS child FROM listed)
SELECT DISTINCT a.parent, a.child FROM (SELECT * FROM up UNION ALL SELECT * FROM down) a JOIN t ON a.child = t.tweet_id WHERE a.parent <> a.child"""


@query("find_roots", f"WITH {tweets(DUCK)} SELECT tweet_id FROM t WHERE inbound AND NOT (parent <> tweet_id AND parent IN (SELECT tweet_id FROM t))")
def find_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents meet ids in an equi-join; Spark runs a negated IN within OR as a nested loop. An id that is null makes the IN of the unmatched null, as in SQL."""
    t = run_sql(spark, sf_dir, f"WITH {tweets(SPARK)} SELECT tweet_id, inbound, parent FROM t")
    ids = t.select(F.col("tweet_id").alias("parent")).distinct().withColumn("met", F.lit(True))
    unnamed = t.agg(F.coalesce(F.bool_or(F.col("tweet_id").isNull()), F.lit(False)).alias("unnamed"))
    there = F.when(F.col("met"), True).when(~F.col("unnamed"), False)
    found = t.where("inbound").join(ids.where("parent is not null"), "parent", "left").crossJoin(F.broadcast(unnamed))  # one row
    return found.where(~((F.col("parent") != F.col("tweet_id")) & there)).select("tweet_id")


@both("threads_with_brand")
def _(d):
    return f"WITH {tweets(d)} SELECT conv_id, count(*) AS n_turns FROM t GROUP BY conv_id HAVING bool_or(author_id = 'brand')"


@both("brand_count")
def _(d):
    return f"WITH {tweets(d)} SELECT count(*) AS total, CAST(sum(CAST(author_id = 'brand' AS INT)) AS BIGINT) AS by_brand, CAST(sum(CAST(inbound AS INT)) AS BIGINT) AS inbound FROM t"


@both("context_before_brand")
def _(d):
    return f"""WITH {tweets(d)}, f AS (SELECT conv_id, min(CASE WHEN author_id = 'brand' THEN turn END) AS first_brand FROM t GROUP BY conv_id)
SELECT t.conv_id, t.turn, t.text FROM t JOIN f ON t.conv_id = f.conv_id WHERE t.turn > 0 AND t.turn < f.first_brand"""


def branch_sql(d) -> str:
    """best(root, path): every root's best branch, paths joined by blanks."""
    return f"""RECURSIVE {tweets(d)}, {edges(d)}, roots AS (SELECT tweet_id AS root FROM t WHERE inbound AND NOT (parent <> tweet_id AND parent IN (SELECT tweet_id FROM t))),
walk(root, node, path) AS (
  SELECT root, root, {d.array('root')} FROM roots
  UNION ALL
  SELECT w.root, e.child, {d.append('w.path', 'e.child')} FROM walk w JOIN e ON w.node = e.parent WHERE {d.size('w.path')} < 20 AND NOT {d.has('w.path', 'e.child')}
), next AS (SELECT DISTINCT w.root, w.path FROM walk w JOIN e ON w.node = e.parent WHERE NOT {d.has('w.path', 'e.child')}),
leaf AS (SELECT w.root, w.path FROM walk w LEFT JOIN next n ON n.root = w.root AND n.path = w.path WHERE n.root IS NULL OR {d.size('w.path')} >= 20),
steps AS (SELECT root, path, {d.explode('path')} AS tweet_id FROM leaf),
scored AS (SELECT s.root, s.path, max(CASE WHEN t.author_id = 'brand' THEN 1 ELSE 0 END) AS has_brand FROM steps s JOIN t ON s.tweet_id = t.tweet_id GROUP BY s.root, s.path),
best AS (SELECT root, path, has_brand FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY has_brand DESC, {d.size('path')} DESC, {d.join('path', ' ')} DESC) AS r FROM scored) s WHERE r = 1)"""


def _tweets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run_sql(spark, sf_dir, f"WITH {tweets(SPARK)} SELECT * FROM t"), run_sql(spark, sf_dir, f"WITH {tweets(SPARK)}, {edges(SPARK)} SELECT * FROM e")


@query("best_branch", f"WITH {branch_sql(DUCK)} SELECT root, {DUCK.join('path', ' ')} AS path, {DUCK.size('path')} AS length, has_brand FROM best")
def best_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _tweets(spark, sf_dir)
    return graph.best_lines(t, e, "brand", depth=20).select("root", F.array_join("path", " ").alias("path"), F.size("path").alias("length"), "has_brand")


def threads(tweets: DataFrame, edges: DataFrame, brand: str = "brand") -> DataFrame:
    """(root, place, and what tweets has) of the turns of each root's best branch, of two turns or more, in order."""
    best = graph.best_lines(tweets, edges, brand, depth=20).where(F.size("path") >= 2)
    return best.select("root", F.posexplode("path").alias("place", "tweet_id")).join(tweets, "tweet_id")


@query(
    "reconstruct_threads",
    f"""WITH {branch_sql(DUCK)}, kept AS (SELECT root, {DUCK.explode('path')} AS tweet_id FROM best WHERE {DUCK.size('path')} >= 2)
SELECT k.root, count(*) AS n_turns, min(t.created_at) AS created_at, max(length(t.text)) AS longest, CAST(sum(CAST(t.author_id = 'brand' AS INT)) AS BIGINT) AS brand_turns FROM kept k JOIN t ON k.tweet_id = t.tweet_id GROUP BY k.root""",
)
def reconstruct_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _tweets(spark, sf_dir)
    return threads(t, e).groupBy("root").agg(F.count("*").alias("n_turns"), F.min("created_at").alias("created_at"), F.max(F.length("text")).alias("longest"), F.sum((F.col("author_id") == "brand").cast("int")).alias("brand_turns"))


@query(
    "brand_neighbourhood",
    f"""WITH RECURSIVE {tweets(DUCK)}, {edges(DUCK)}, u AS (SELECT parent AS a, child AS b FROM e UNION SELECT child, parent FROM e),
walk(node, hop) AS (SELECT tweet_id, 0 FROM t WHERE author_id = 'brand' UNION SELECT u.b, walk.hop + 1 FROM walk JOIN u ON walk.node = u.a WHERE walk.hop < 6)
SELECT node AS tweet_id, min(hop) AS hop FROM walk GROUP BY node""",
)
def brand_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _tweets(spark, sf_dir)
    return graph.neighbourhood(e, t.where("author_id = 'brand'").select("tweet_id"), hops=6).select(F.col("node").alias("tweet_id"), "hop")


@query("best_branch_loop", f"WITH {branch_sql(DUCK)} SELECT root, {DUCK.join('path', ' ')} AS path, has_brand FROM best")
def best_branch_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop form, without the limits of a recursive query."""
    t, e = _tweets(spark, sf_dir)
    return graph.best_branches(t, e, "brand", depth=20)
