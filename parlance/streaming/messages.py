"""The message path as a stream: clean, drop repeats within a watermark, and route; stateless but for the repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import SPARK


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """Adds cleaned, reason (kept or why not) and dedupe_key."""
    out = stream.selectExpr("*", f"{T.clean_customer(SPARK, text)} AS cleaned")
    return out.selectExpr("*", f"{T.quality_reason(SPARK, 'cleaned')} AS reason", f"{T.dedupe_key(SPARK, 'cleaned')} AS dedupe_key")


def first_seen(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """The first message of each dedupe_key within the watermark, whose state it bounds."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["dedupe_key"])


def routed(stream: DataFrame, text: str = "cleaned") -> DataFrame:
    """Adds code, the first safety rule that a message meets (null if none), and route."""
    out = stream.selectExpr("*", f"{T.first_rule(SPARK, text, P.RULES)} AS code")
    return out.selectExpr("*", "CASE WHEN code IS NULL THEN 'auto' ELSE 'escalate' END AS route")
