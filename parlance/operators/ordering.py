"""Places in a global order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.tables import written

#: Rows that a task sorts.
ROWS = 200_000


def numbered(df: DataFrame, by: str, then: str, name: str = "place") -> tuple[DataFrame, int]:
    """df with the 1-based place of each row in the order of (by, then), nulls first, and the number of rows.

    A row's place is the number of rows in the ranges before its own and its place there; there are as many ranges as
    the rows need, cut over both columns, so a frequent value of by makes no long range.
    """
    n = df.count()
    if n <= ROWS:
        return df.withColumn("_range", F.lit(0)).withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(by, then))).drop("_range"), n
    rows = ranged(df, [by, then], "_tie", ROWS)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("s"))
    start = sizes.select("_range", (F.sum("s").over(Window.orderBy("_range")) - F.col("s")).alias("_start"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by, then, "_tie"))
    return rows.withColumn(name, within).join(F.broadcast(start), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start", "_tie"), n


def ranged(df: DataFrame, order: list[str], tie: str = "_tie", rows: int = ROWS) -> DataFrame:
    """df, written to the shared folder, with _range, which rises in the order of the columns, and a number that tells equal rows apart.

    The ranges are cut by Spark's sample over all columns of the order, some rows each whatever the size of the table, so
    neither many rows nor one frequent value of the first column make a long range. Rows that are equal in the whole order share one.
    """
    n = df.count()
    cut = df.repartitionByRange(max(1, -(-n // rows)), *order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias(tie))
    return written(cut, "ranges")


def in_file_order(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a plain file scan, written to the shared folder, with their 0-based place in the order of file paths and of rows in each file.

    Each split of a file counts its own rows; the splits before it give its offset, so no task sees more than a split.
    """
    seen = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    kept = written(seen, "places")
    splits = kept.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("n"))
    offset = F.sum("n").over(Window.orderBy("_file", "_block")) - F.col("n")  # a row a split
    return kept.join(splits.select("_file", "_block", "_first", offset.alias("_offset")), ["_file", "_block"]).withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")).drop("_file", "_block", "_first", "_offset", "_id")
