"""CSV files with line breaks inside quotes, read in splits, with bad records kept apart.

A file is read by lines. The number of quotes before a line says whether it is inside a quoted field: sums within each split
and the sums of the splits before it, so one huge file is as good as many. Where a file's quotes don't pair up, one of its
records has a torn quote; in such a file every line that starts like a record (an id, an author, a flag) starts one, so the tear
costs one record and not the rest of the file. (Two tears in one file pair up and aren't seen.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.tables import written

QUOTED = '"(?:[^"]|"")*"'
#: What a record of messages starts with, whatever follows.
HEAD = r"^\d+,[^,\"]*,(?:True|False),"


class Header(ValueError):
    """Files that lack a column."""


def _records(spark: SparkSession, path: str, head: str) -> DataFrame:
    """(file, line, record): every record of every file, its header included, with the number of its first line from 1."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), F.col("value").rlike(head).cast("long").alias("head"),
    )
    kept = written(lines, "lines")
    splits = kept.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("quotes").alias("q"), F.sum("head").alias("h"))
    by_file = Window.partitionBy("file").orderBy("block")  # a row a split
    so_far = lambda c: (F.sum(c).over(by_file) - F.col(c)).alias(f"{c}0")
    torn = (F.sum("q").over(Window.partitionBy("file")) % 2 == 1).alias("torn")
    splits = splits.select("file", "block", "first", so_far("n"), so_far("q"), so_far("h"), torn)
    within = Window.partitionBy("file", "block").orderBy("at")
    rows = kept.join(splits, ["file", "block"])
    rows = rows.select(
        "file", "block", "at", "value", "quotes", "torn", (F.col("n0") + F.col("at") - F.col("first") + 1).alias("line"),
        (F.col("q0") + F.sum("quotes").over(within) - F.col("quotes")).alias("before"), (F.col("h0") + F.sum("head").over(within)).alias("stretch"), "head",
    )
    whole = rows.where("not torn").withColumn("start", F.col("before") % 2 == 0)
    since = Window.partitionBy("file", "stretch").orderBy("line")  # from one head to the next
    mended = rows.where("torn").withColumn("start", (F.col("head") == 1) | ((F.sum("quotes").over(since) - F.col("quotes")) % 2 == 0))
    starts = written(whole.unionByName(mended).select("file", "block", "line", "value", "start"), "starts")
    counts = starts.groupBy("file", "block").agg(F.count_if("start").alias("s"))
    counts = counts.select("file", "block", (F.sum("s").over(by_file) - F.col("s")).alias("s0"))
    number = F.col("s0") + F.sum(F.col("start").cast("long")).over(Window.partitionBy("file", "block").orderBy("line"))
    placed = starts.join(counts, ["file", "block"]).select("file", "line", "value", number.alias("number"))
    made = placed.groupBy("file", "number").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    return made.select("file", "line", "number", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...], head: str = HEAD) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the columns as text, missing values empty, of all good records; and (file, line, reason, record) of the others.

    Every file needs a header with all the columns, in any order and among others; Header names up to five files that
    lack one. A record with too many fields or a torn quote is bad and no row; a short one is padded and listed too, as
    `short`. Blank lines are skipped; files without a line have no header and are skipped. Rows have no order.
    """
    records = written(_records(spark, path, head), "records")
    first = records.where("number = 1").select("file", F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r$", "").alias("header"))
    headers = [r["header"] for r in first.select("header").distinct().limit(1001).collect()]
    if len(headers) > 1000:
        raise Header(f"{path}: over 1000 different headers")
    named = {h: [c.strip().strip('"') for c in h.split(",")] for h in headers}
    lacking = {h: [c for c in columns if c not in names] for h, names in named.items()}
    if any(lacking.values()):
        found = first.where(F.col("header").isin([h for h, m in lacking.items() if m])).orderBy("file").limit(5).collect()
        raise Header("; ".join(f"{r['file']}: missing columns: {', '.join(lacking[r['header']])}" for r in found))
    bare = F.regexp_replace("record", QUOTED, "")
    body = records.where(F.col("number") > 1).where(F.trim("record") != "").join(first, "file")
    body = body.withColumn("fields", F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1)
    quotes = F.length("record") - F.length(F.replace("record", F.lit('"'), F.lit("")))
    rows, bads = [], []
    for header, names in named.items():
        of = body.where(F.col("header") == header)
        reason = F.when(quotes % 2 == 1, "torn quote").when(F.col("fields") > len(names), "too many fields").when(F.col("fields") < len(names), "short")
        of = of.withColumn("reason", reason)
        parsed = F.from_csv("record", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
        good = of.where("reason is null or reason = 'short'").select(parsed.alias("p"))
        rows.append(good.select(*[F.coalesce(F.col(f"p.c{names.index(c)}"), F.lit("")).alias(c) for c in columns]))
        bads.append(of.where("reason is not null").select("file", "line", "reason", "record"))
    if not rows:
        empty = records.limit(0)
        return empty.select(*[F.col("record").alias(c) for c in columns]), empty.select("file", "line", F.col("record").alias("reason"), "record")
    out, bad = rows[0], bads[0]
    for more, worse in zip(rows[1:], bads[1:], strict=True):
        out, bad = out.unionByName(more), bad.unionByName(worse)
    return out, bad
