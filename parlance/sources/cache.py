"""Sinks of small documents, the cache of model replies, and the cache of embeddings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.store import KeyedStore


class OfflineMiss(RuntimeError):
    """A reply that is not in the cache was asked for while no model may be called."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at, jvm


def write_document(spark: SparkSession, path: str, value) -> None:
    """One JSON document, in any store that Spark knows; it takes its place in one rename, so readers see the old one or the new one, and of two writers one wins whole."""
    fs, at, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(part, at, how)
    except Exception:
        fs.delete(part, False)
        raise


def read_document(spark: SparkSession, path: str):
    """What write_document() wrote; None where there is nothing that can be read as JSON."""
    fs, at, jvm = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    except ValueError:
        return None
    finally:
        stream.close()


class Replies:
    """Model replies by key, one document each, for single calls on the driver; a broken document counts as missing. Tables of requests go through operators/client.py."""

    def __init__(self, spark: SparkSession, root: str, offline: bool = True):
        self.spark, self.root, self.offline = spark, root.rstrip("/"), offline

    def path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str):
        return read_document(self.spark, self.path(key))

    def put(self, key: str, value) -> None:
        write_document(self.spark, self.path(key), value)

    def reply(self, key: str, ask: Callable[[], object] | None = None):
        """The cached reply, or that of ask(), which is kept; offline a missing reply raises."""
        if (found := self.get(key)) is not None:
            return found
        if self.offline or ask is None:
            raise OfflineMiss(f"no reply for {key}")
        self.put(key, value := ask())
        return value


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table, one folder for each value of the columns of by."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def embedded(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], buckets: int = 64) -> DataFrame:
    """(key, embedding) of the distinct texts of a table; embed turns (key, text) into (key, embedding) for those that the store at path lacks, which then holds them too.

    Two runs at once may both embed a text; it is kept once. A run that dies leaves the store as it was.
    """
    wanted = texts.select(F.sha2("text", 256).alias("key"), "text").where("text is not null").dropDuplicates(["key"])
    store = KeyedStore(texts.sparkSession, path, "embedding array<double>", buckets)
    new = wanted.join(store.missing(wanted), "key", "left_semi")
    if not new.isEmpty():
        store.put(embed(new))
    return store.get(wanted.select("key")).where("found").select("key", "embedding")
