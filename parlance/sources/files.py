"""Readers and writers of the files that the engine takes and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.records import read_records

TWEET_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")


def read_tweets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV files with every column as text and missing values as empty text; raises if a file lacks one of the seven columns. Bad records are left out; tweets_and_bad() has them."""
    rows, _ = tweets_and_bad(spark, path)
    return rows.limit(limit) if limit is not None else rows


def tweets_and_bad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The messages of CSV files, and (file, line, reason, record) of records with torn quotes, too many fields or too few."""
    return read_records(spark, path, TWEET_COLUMNS)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a declared schema, so that ids stay text."""
    return spark.read.schema(schema).json(path)


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, one folder for each value of a column."""
    df.write.partitionBy(by).mode("overwrite").json(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(intent, definition, positives) from a markdown file: sections headed by a name in back quotes, with at most three quoted examples."""
    whole = spark.read.text(path, wholetext=True)
    part = whole.select(F.explode(F.split("value", r"(?m)^## ")).alias("part")).where(F.col("part").startswith("`"))
    body = F.regexp_replace("part", r"^`[^`]*`\s*", "")
    return part.select(
        F.regexp_extract("part", "^`([^`]+)`", 1).alias("intent"), F.regexp_replace(F.split(body, r"\n\s*\n|\n[-*>] ")[0], r"\s+$", "").alias("definition"),
        F.slice(F.regexp_extract_all("part", F.lit(r'(?m)^[-*>] "([^"\n]+)"'), 1), 1, 3).alias("positives"),
    )


def missing_intents(codebook: DataFrame, intents: list[str]) -> DataFrame:
    """The intents that a codebook lacks."""
    wanted = codebook.sparkSession.createDataFrame([(i,) for i in intents], "intent string")
    return wanted.join(codebook, "intent", "left_anti")


def parse_timestamp(column: str = "created_at"):
    """A timestamp of the form `Tue Oct 31 22:10:47 +0000 2017`; null where it can't be read."""
    return F.try_to_timestamp(F.substring(column, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def synthetic_pairs(spark: SparkSession, n: int = 4000, seed: int = 20260909) -> DataFrame:
    """Made-up messages and replies, marked as such; the same for one seed however they are partitioned."""
    asks = ["my app keeps crashing", "i was charged twice", "how do i cancel", "please add dark mode", "cannot log in"]
    replies = ["Try restarting the app and clearing your cache", "Can you DM us your account email", "You can cancel in your settings", "Thanks, your feedback has been noted"]
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    return spark.range(n).select(
        (F.col("id") * 2).cast("string").alias("tweet_id"), F.concat(F.lit("SYNTHETIC "), pick(asks, 1)).alias("text"),
        (F.col("id") * 2 + 1).cast("string").alias("reply_id"), F.concat(F.lit("SYNTHETIC "), pick(replies, 2)).alias("reply"),
    )
