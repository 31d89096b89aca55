"""Shared folder, cut lineage, connected components: what several operators need of the cluster."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, and only in local mode, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a read and not the whole lineage."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex[:12]}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch that no later step reads."""
        self._delete(df._scratch)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables of this scratch so far that the given ones don't read."""
        files = [f for t in tables for f in t.inputFiles()]
        for k in range(1, self.n + 1):
            if not any(f"{self.root}/{k}/".rpartition("/parlance/")[2] in f for f in files):
                self._delete(f"{self.root}/{k}")

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows that may be broadcast, some 30 MB at most once hashed, and bytes of their texts and arrays.
SMALL_ROWS, SMALL_BYTES = 400_000, 16 << 20


def _bytes(field: T.StructField) -> Column:
    """Bytes of a value beyond the few that a number takes."""
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(field.dataType, T.ArrayType):
        return F.octet_length(F.array_join(c, "")) + F.size(c) * 8 if isinstance(field.dataType.elementType, T.StringType) else F.size(c) * 8
    return F.lit(0)


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Ask to broadcast a written table if its rows are counted and its texts measured to be few; a larger one is joined by a shuffle."""
    size = sum((F.coalesce(_bytes(f), F.lit(0)) for f in table.schema), F.lit(0)).cast("long")
    seen = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(table) if seen["n"] <= rows and seen["b"] <= SMALL_BYTES else table


def quoted(name: str) -> str:
    """A column name that may hold dots, as F.col() takes it."""
    return "`" + name.replace("`", "``") + "`"


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def release() -> None:
    """Give memory that is free back to the system; a worker that is used again would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run):
    """A function for mapInArrow() that leaves no free memory behind in its worker."""

    def tidied(batches):
        release()
        yield from run(batches)
        release()

    return tidied


def plain(df: DataFrame) -> DataFrame:
    """df with numbered columns, as mapInArrow() doesn't take names with dots; its schema gives the names back."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def one_row_each(scratch: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(doc_id, text) without the repeats of a (doc_id, text); ids has the doc_id of every row and is cheap to read."""
    twice = scratch.table(ids.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return docs
    twice = small(twice)
    return docs.join(twice, "doc_id", "left_anti").unionByName(docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over distinct edges (a, b), a > b: large links each larger neighbour, small each smaller one, to the least."""
    near = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if small:
        out = near.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        out = near.join(least, "a").where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: (id, component), component the least id; ids without edges are left out.

    edges has long columns a and b; null ends and loops are ignored. Each round is two joins on a node, and its
    edge list replaces the last one in the shared folder, so nothing gathers on the driver but a count and a checksum.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or tuple(seen) == last:
            break
        last = tuple(seen)
        after = scratch.table(_star(_star(now, small=False), small=True))
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
