"""Graph operators over (parent, child) edges, as loops of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.tables import cut


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 6) -> DataFrame:
    """(node, hop): everything within so many hops of the seeds, either way along edges, with its least hop."""
    ways = cut(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))).distinct())
    level = seen = cut(seeds.toDF("node").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, hops + 1):
        after = level.join(ways, level.node == ways.a).select(F.col("b").alias("node")).distinct()
        level = cut(after.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def roots(tweets: DataFrame) -> DataFrame:
    """Inbound messages whose parent is not in the data."""
    ids = tweets.select(F.col("tweet_id").alias("known"))
    return tweets.where("inbound").join(ids, (F.col("parent") == F.col("known")) & (F.col("parent") != F.col("tweet_id")), "left_anti").select(F.col("tweet_id").alias("root"))


def best_branches(tweets: DataFrame, edges: DataFrame, brand: str, depth: int = 20) -> DataFrame:
    """(root, path, has_brand): of each root's simple paths to a leaf the one with a brand turn, then the longest, then the largest.

    Each step is one join along edges; a path that can't go on keeps its place as a leaf. The loop ends with the
    longest path, whose length is the one thing the driver is told.
    """
    brands = tweets.where(F.col("author_id") == brand).select(F.col("tweet_id").alias("node"), F.lit(1).alias("b")).distinct()
    mark = lambda df: df.join(brands, "node", "left").withColumn("has_brand", F.greatest("has_brand", F.coalesce("b", F.lit(0)))).drop("b")
    live = mark(roots(tweets).select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.lit(0).alias("has_brand")))
    leaves = []
    for _ in range(depth - 1):
        on = live.alias("w").join(edges.alias("e"), (F.col("w.node") == F.col("e.parent")) & ~F.array_contains("w.path", F.col("e.child")))
        after = mark(on.select("w.root", F.col("e.child").alias("node"), F.array_append("w.path", F.col("e.child")).alias("path"), "w.has_brand"))
        leaves.append(live.join(on.select("w.root", "w.path").distinct(), ["root", "path"], "left_anti"))
        live = cut(after)
        if live.isEmpty():
            break
    else:
        leaves.append(live)
    every = reduce(DataFrame.unionByName, leaves).select("root", F.array_join("path", " ").alias("path"), "has_brand", F.size("path").alias("n"))
    return every.groupBy("root").agg(F.max(F.struct("has_brand", "n", "path")).alias("top")).select("root", "top.path", "top.has_brand")


def lines(tweets: DataFrame, edges: DataFrame, brand: str, depth: int = 20) -> DataFrame:
    """(node, top, path, has_brand): the way from the topmost message down to each one that is at most so many messages away from it, by pointer jumping.

    Every message first points to its parent; in each round it points to where that one points, and puts what lies between in
    front of its own way. After log2(depth) joins all ways that are short enough reach the top; those that grow beyond
    depth, and those that run in a circle, are dropped. Each message may have one parent; the least of several counts.
    """
    up = edges.where("parent <> child").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("far"))
    nodes = tweets.groupBy(F.col("tweet_id").alias("node")).agg(F.max((F.col("author_id") == brand).cast("int")).alias("has_brand"))
    now = cut(nodes.join(up, "node", "left").select("node", "far", F.array("node").alias("path"), F.coalesce("has_brand", F.lit(0)).alias("has_brand")))
    for _ in range((depth - 1).bit_length()):
        live = now.where("far is not null")
        if live.isEmpty():
            break
        on = now.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("path").alias("above"), F.col("has_brand").alias("b"))
        moved = live.join(on, "far").select("node", F.col("next").alias("far"), F.concat("above", "path").alias("path"), F.greatest("has_brand", "b").alias("has_brand"))
        keep = F.when(F.col("far").isNull(), F.size("path") <= depth).otherwise(F.size("path") < depth)
        now = cut(now.where("far is null").unionByName(moved.where(keep)))
    return now.where("far is null").select("node", F.element_at("path", 1).alias("top"), "path", "has_brand")


def best_lines(tweets: DataFrame, edges: DataFrame, brand: str, depth: int = 20) -> DataFrame:
    """(root, path as array, has_brand): of each root's ways to a leaf, or to the depth, the one with a brand turn, then the longest, then the largest as text."""
    ways = lines(tweets, edges, brand, depth).join(roots(tweets).distinct(), F.col("top") == F.col("root"), "left_semi")
    parents = edges.where("parent <> child").select(F.col("parent").alias("node")).distinct()
    ends = ways.where(F.size("path") == depth).unionByName(ways.where(F.size("path") < depth).join(parents, "node", "left_anti"))
    top = F.max(F.struct("has_brand", F.size("path").alias("n"), F.array_join("path", " ").alias("text"), "path")).alias("best")
    return ends.groupBy(F.col("top").alias("root")).agg(top).select("root", "best.path", "best.has_brand")
