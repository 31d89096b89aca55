"""Every query of the engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from parlance import plans

    plans.load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["quality_reason"](spark, sf_dir)
