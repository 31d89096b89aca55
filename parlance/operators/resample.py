"""The bootstrap as an aggregate: rows are read once, and a replicate is a vector of counts, never a copy of rows.

What a statistic needs of an example is a few numbers that add up (its state: hits, costs, counts of classes). Equal states of
a group become one cell with a count. A replicate draws as many examples as the group has, with replacement: how many fall to
each of up to PARTS parts is drawn on the driver as a multinomial (a group and part each a number), and each part, a task of
its own, splits its number among its cells by a multinomial again, which together is a draw from all rows. The parts' sums of
states are added; the statistic is an expression over the sums of a replicate, its interval a percentile over replicates.

Draws depend on seed, group and part alone, so results repeat, in whatever order tasks run. Groups of the same name are
drawn apart; null states count as 0. A group without rows has no interval.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.tables import written
from parlance.session import ship

REPLICATES, SEED, PARTS, CELLS = 1000, 20260909, 256, 50_000
#: Counts that a task holds at a time.
HELD = 1 << 21


def _draw(sent, states: list[str], seed: int):
    def run(key, table):
        group, part = key[0].as_py(), key[1].as_py()
        table = table.sort_by([(c, "ascending") for c in [*states, "w"]])
        weight = table.column("w").to_numpy().astype(np.float64)
        values = np.column_stack([table.column(c).to_numpy().astype(np.float64) for c in states])
        numbers = sent.value[group][part]  # examples of each replicate in this part
        r = np.random.Generator(np.random.PCG64([seed, part, *group.encode()]))
        step = max(1, HELD // len(weight))
        sums = [r.multinomial(numbers[a : a + step], weight / weight.sum()) @ values for a in range(0, len(numbers), step)]
        sums = np.concatenate(sums)
        return pa.table({"grp": pa.array([group] * len(sums)), "replicate": np.arange(len(sums), dtype=np.int32), **{c: sums[:, k] for k, c in enumerate(states)}})

    return run


def replicates(rows: DataFrame, states: list[str], n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(grp, replicate, sums of the states) of n resamples of rows(grp, states) in each group."""
    spark = rows.sparkSession
    ship(spark)
    typed = rows.select(F.col("grp").cast("string").alias("grp"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in states)).where("grp is not null")
    cells = written(typed.groupBy("grp", *states).agg(F.count("*").alias("w")), "cells")
    parts = max(1, min(PARTS, -(-cells.count() // CELLS)))
    cells = cells.withColumn("part", F.pmod(F.xxhash64(*states), F.lit(parts)).cast("int"))
    totals: dict[str, dict[int, int]] = {}
    for t in cells.groupBy("grp", "part").agg(F.sum("w").alias("w")).collect():  # groups times PARTS at most
        totals.setdefault(t["grp"], {})[t["part"]] = t["w"]
    split = {}
    for group, own in totals.items():
        keys, sizes = sorted(own), np.array([own[k] for k in sorted(own)])
        r = np.random.Generator(np.random.PCG64([seed, 1 << 20, *group.encode()]))
        split[group] = dict(zip(keys, r.multinomial(sizes.sum(), sizes / sizes.sum(), size=n).T, strict=True))
    sent = spark.sparkContext.broadcast(split)
    schema = "grp string, replicate int, " + ", ".join(f"{c} double" for c in states)
    drawn = cells.groupBy("grp", "part").applyInArrow(_draw(sent, states, seed), schema)
    return drawn.groupBy("grp", "replicate").agg(*(F.sum(c).alias(c) for c in states)) if parts > 1 else drawn


def intervals(rows: DataFrame, states: list[str], statistics: dict[str, str], n: int = REPLICATES, seed: int = SEED, ci: float = 0.95) -> DataFrame:
    """(grp, statistic, point, lo, hi, half_width): each statistic, an SQL expression over sums of states, on all rows and as a percentile interval of its replicates."""
    numbers = F.expr("stack(" + str(len(statistics)) + ", " + ", ".join(f"'{name}', CAST({e} AS DOUBLE)" for name, e in statistics.items()) + ") AS (statistic, value)")
    typed = rows.select(F.col("grp").cast("string").alias("grp"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in states)).where("grp is not null")
    point = typed.groupBy("grp").agg(*(F.sum(c).alias(c) for c in states)).select("grp", numbers).withColumnRenamed("value", "point")
    seen = replicates(rows, states, n, seed).select("grp", numbers).groupBy("grp", "statistic").agg(F.percentile("value", F.lit((1 - ci) / 2)).alias("lo"), F.percentile("value", F.lit((1 + ci) / 2)).alias("hi"))
    return point.join(seen, ["grp", "statistic"]).withColumn("half_width", (F.col("hi") - F.col("lo")) / 2)
