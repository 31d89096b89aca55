"""Checks that stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordering import in_file_order


class Leakage(RuntimeError):
    """Retrieval returned rows of a split that it must not see."""


def no_leaks(hits: DataFrame, held: DataFrame, shown: int = 5) -> DataFrame:
    """hits(id, ...) if none of its ids is in held(id); raises with up to five of them otherwise."""
    found = hits.select("id").join(held.select("id"), "id", "left_semi").distinct().orderBy("id").limit(shown).collect()
    if found:
        raise Leakage("retrieved ids of a held-out split: " + ", ".join(str(r["id"]) for r in found))
    return hits


def none_held(hits: DataFrame, held: DataFrame, shown: int = 5) -> DataFrame:
    """hits(id, ...), as part of whatever plan they go into: the job that reads them stops if one of their ids is in held(id), and names up to five."""
    found = hits.select("id").join(held.select("id"), "id", "left_semi").distinct().orderBy("id").limit(shown)
    word = found.agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ", ").alias("_leaked"))  # one row
    stop = F.raise_error(F.concat(F.lit("retrieved ids of a held-out split: "), F.col("_leaked")))
    return hits.crossJoin(F.broadcast(word)).withColumn("id", F.when(F.col("_leaked") != "", stop.cast(hits.schema["id"].dataType)).otherwise(F.col("id"))).drop("_leaked")


def stopped_by(rows: DataFrame, bad: DataFrame, column: str, message: str, shown: int = 5) -> DataFrame:
    """rows, as part of whatever plan they go into: the job that reads them stops if bad(id) has rows, and names up to five ids."""
    some = bad.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id")).distinct().orderBy("id").limit(shown)
    word = some.agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("_bad"))  # one row
    stop = F.raise_error(F.concat(F.lit(message + ": "), F.col("_bad"))).cast(rows.schema[column].dataType)
    return rows.crossJoin(F.broadcast(word)).withColumn(column, F.when(F.col("_bad") != "", stop).otherwise(F.col(column))).drop("_bad")


def side_by_side(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Two file scans joined by place, as one struct column each: (place, left, right). The job that reads them stops where one has a row more or another key, and names up to five keys."""
    a, b = (in_file_order(df).select("place", F.struct(*df.columns).alias(side)) for df, side in ((left, "left"), (right, "right")))
    pairs = a.join(b, "place", "full")
    off = pairs.where(F.col("left").isNull() | F.col("right").isNull() | ~F.col(f"left.{key}").eqNullSafe(F.col(f"right.{key}")))
    return stopped_by(pairs, off.select(F.coalesce(F.col(f"left.{key}"), F.col(f"right.{key}")).alias("id")), "place", "rows that are not side by side")
