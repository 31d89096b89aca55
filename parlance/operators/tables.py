"""Derived tables in the folder that all executors share: written once, read by every query that needs them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, and only in local mode, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="parlance-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stamp(spark: SparkSession, path: str) -> tuple:
    """Files, bytes and last change of what lies at a path; another one means that the table is another one."""
    fs, at = _file_system(spark, path)
    size = fs.getContentSummary(at)
    return path, size.getFileCount(), size.getLength(), fs.getFileStatus(at).getModificationTime()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def once(spark: SparkSession, key: tuple, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that build() made for this key in this application; made anew if their files are gone."""
    known = getattr(spark.sparkContext, "_parlance_tables", None)
    if known is None:
        known = spark.sparkContext._parlance_tables = {}
    paths, facts = known.get(key, (None, None))
    if paths is not None and all(_exists(spark, p) for p, _ in paths.values()):
        return {name: spark.read.schema(schema).parquet(p) for name, (p, schema) in paths.items()} | facts
    made = build()
    tables = {name: df if hasattr(df, "_kept") else written(df, name) for name, df in made.items() if isinstance(df, DataFrame)}
    facts = {name: x for name, x in made.items() if not isinstance(x, DataFrame)}
    known[key] = {name: (df._kept, df.schema) for name, df in tables.items()}, facts
    return tables | facts


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(at)
