"""A spending limit over a ledger of calls, as a batch and as a stream.

Calls are taken in the order of (ts, call_id). A call whose total before it has reached the cap is refused and costs nothing; one
that finds the warning share of the cap reached is made by the cheapest model; unknown models cost nothing. Money is counted in
whole billionths of a dollar, so that sums are exact and do not depend on how rows are split. Null tokens are none; calls
without a ts or a call_id come first in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.ordering import ranged
from parlance.session import ship

WARN = 80  # percent of the cap
DECIDED = "call_id string, model string, used string, status string, nano_usd long, before_nano long"


def nano_prices(prices: dict[str, tuple[float, float]]) -> dict[str, tuple[int, int]]:
    """Billionths of a dollar a token from dollars a million tokens."""
    return {m: (round(a * 1000), round(b * 1000)) for m, (a, b) in prices.items()}


def _cost(prices: dict[str, tuple[int, int]], model) -> F.Column:
    """Of a row, at the prices of a model."""
    side = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[i])]).cast("map<string,bigint>"), F.coalesce(model, F.lit(""))), F.lit(0))
    return F.coalesce(F.col("prompt_tokens"), F.lit(0)) * side(0) + F.coalesce(F.col("completion_tokens"), F.lit(0)) * side(1)


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The sum of value over all rows before each one: sums of the ranges before its own, and a window within it."""
    sums = rows.groupBy("_range").agg(F.sum(value).alias("s"))
    start = sums.select("_range", (F.sum("s").over(Window.orderBy("_range")) - F.col("s")).alias("_start"))  # a row a range
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("ts", "call_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(F.broadcast(start), "_range").withColumn(name, F.col("_start") + F.col("_within")).drop("_within", "_start")


def decided(calls: DataFrame, prices: dict[str, tuple[float, float]], cheapest: str, cap_nano: int, warn: int = WARN) -> DataFrame:
    """calls(call_id, ts, model, prompt_tokens, completion_tokens) as DECIDED; before_nano is null for a refused call.

    Until the warning share is reached the total is that of the wished models; from then on each call is at the cheapest
    price. Both totals are running sums over ranges of the order, so no task sees all calls.
    """
    price = nano_prices(prices)
    rows = calls.select(F.col("call_id").cast("string"), "ts", "model", "prompt_tokens", "completion_tokens")
    rows = rows.withColumn("own", _cost(price, F.col("model"))).withColumn("cheap", _cost(price, F.lit(cheapest))).drop("prompt_tokens", "completion_tokens")
    rows = _before(ranged(rows, ["ts", "call_id"], "_tie"), "own", "_wished")
    late = (F.col("_wished") * 100 >= cap_nano * warn) & ~F.col("model").eqNullSafe(cheapest)
    rows = _before(rows.withColumn("late", late).withColumn("cost", F.when(F.col("late"), F.col("cheap")).otherwise(F.col("own"))), "cost", "before")
    refused = F.col("before") >= cap_nano
    return rows.select(
        "call_id", "model", F.when(refused, None).when(F.col("late"), F.lit(cheapest)).otherwise(F.col("model")).alias("used"),
        F.when(refused, "refused").when(F.col("late"), "downgraded").otherwise("made").alias("status"),
        F.when(refused, F.lit(0)).otherwise(F.col("cost")).cast("long").alias("nano_usd"), F.when(~refused, F.col("before")).cast("long").alias("before_nano"),
    )


class Spending(StatefulProcessor):
    """Keeps the total of a ledger."""

    def __init__(self, prices: dict[str, tuple[int, int]], cheapest: str, cap_nano: int, warn: int):
        self.prices, self.cheapest, self.cap, self.warn = prices, cheapest, cap_nano, warn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "nano long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ts", "call_id"], na_position="first", kind="stable")
        spent, out = (self.total.get()[0] if self.total.exists() else 0), []
        for call, model, n_in, n_out in calls[["call_id", "model", "prompt_tokens", "completion_tokens"]].itertuples(index=False, name=None):
            if spent >= self.cap:
                out.append((call, model, None, "refused", 0, None))
                continue
            late = spent * 100 >= self.cap * self.warn and model != self.cheapest
            used = self.cheapest if late else model
            a, b = self.prices.get(used, (0, 0))
            cost = int(n_in) * a + int(n_out) * b
            out.append((call, model, used, "downgraded" if late else "made", cost, spent))
            spent += cost
        self.total.update((spent,))
        frame = pd.DataFrame(out, columns=["call_id", "model", "used", "status", "nano_usd", "before_nano"])
        yield frame.astype({"call_id": object, "model": object, "used": object, "status": object, "nano_usd": "int64", "before_nano": "Int64"})

    def close(self) -> None:
        pass


def spending(stream: DataFrame, prices: dict[str, tuple[float, float]], cheapest: str, cap_nano: int, warn: int = WARN) -> DataFrame:
    """The same decisions on a stream; the total lives in the state store (RocksDB), so a restarted query goes on from it.

    One total is one key, so a trigger's calls meet in one task: bound them by the source's rows or files a trigger. Calls are
    ordered within a trigger; the order across triggers is that of arrival.
    """
    ship(stream.sparkSession)
    tokens = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = stream.select(F.lit(0).alias("ledger"), F.col("call_id").cast("string"), "ts", "model", tokens("prompt_tokens"), tokens("completion_tokens"))
    return rows.groupBy("ledger").transformWithStateInPandas(Spending(nano_prices(prices), cheapest, cap_nano, warn), DECIDED, "Append", "None")
