"""The queries of this subpackage and the pipeline, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from parlance.llm import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_queries.QUERIES, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {**_queries.ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
