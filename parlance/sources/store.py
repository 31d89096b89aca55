"""A table of values by key that many jobs read and write at once.

root/data/batch=<name>/bucket=<n>/ holds what one write left; root/manifests/<version>.json lists the batches that count, in order.
A batch counts from the moment that a new manifest takes its name, so a write that was killed leaves the version before it,
and readers of an older manifest keep reading its batches. Two writers take the same next version; one of them finds the name
taken, reads the manifest again and tries the next. The claim is a rename that does not overwrite, atomic on HDFS and on file
systems like it; for local files it is also guarded within this process, and stores without such a rename need one writer.

Of several values of a key the one of the last batch counts. Within a batch the first in the order of its columns as JSON does.
Rows with a null key are not kept. A file that can't be read is as good as missing: its keys miss (or show an older value), and damaged() lists its bucket.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches that are merged into one before a write adds another, so that a key has no more copies than this.
BATCHES = 32
#: Times that a write looks for a free version.
TRIES = 100

_claims = threading.Lock()


class Conflict(RuntimeError):
    """Other writers took every version that a write tried to take."""


class KeyedStore:
    """Values of a schema by a string key, in hash buckets."""

    def __init__(self, spark: SparkSession, root: str, value: T.StructType | str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.value = value if isinstance(value, T.StructType) else T._parse_datatype_string(value)
        if taken := {"key", "bucket", "batch"} & set(self.value.names):
            raise ValueError(f"columns that the store has itself: {', '.join(sorted(taken))}")
        self.schema = T.StructType([T.StructField("key", T.StringType()), *self.value.fields])
        self.jvm = spark._jvm
        at = self.jvm.org.apache.hadoop.fs.Path(self.root)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    # manifests

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """The versions whose manifests are there."""
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, batches: [{name, rows: {bucket: rows}}]} of a version, or of the last one."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "buckets": self.buckets, "batches": []}
            version = known[-1]
        stream = self.fs.open(self._path("manifests", f"{version:010d}.json"))
        try:
            found = json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        if found["buckets"] != self.buckets:
            raise ValueError(f"{self.root} has {found['buckets']} buckets, not {self.buckets}")
        return found

    def _claim(self, manifest: dict) -> bool:
        """Whether the manifest got its version."""
        part, at = self._path("manifests", f"{uuid.uuid4().hex}.part"), self._path("manifests", f"{manifest['version']:010d}.json")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        with _claims:
            try:
                self.context.rename(part, at, how)
                return True
            except Exception:
                self.fs.delete(part, False)
                if not self.fs.exists(at):
                    raise
                return False

    def _commit(self, change) -> int:
        """Takes the next version for change(batches), which may be asked again; returns the version."""
        for _ in range(TRIES):
            last = self.manifest()
            after = {"version": last["version"] + 1, "buckets": self.buckets, "batches": change(last["batches"])}
            if self._claim(after):
                return after["version"]
        raise Conflict(f"{self.root}: no free version in {TRIES} tries")

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict:
        """A batch that no manifest lists yet."""
        batch = {"name": uuid.uuid4().hex}
        path = f"{self.root}/data/batch={batch['name']}"
        placed = rows.withColumn("bucket", self._bucket())
        placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
        sizes = self._read([batch], strict=True).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row a bucket
        batch["rows"] = {str(r["bucket"]): r["n"] for r in sizes}
        return batch

    def _read(self, batches: list[dict], strict: bool = False) -> DataFrame:
        """(key, ..., bucket, batch) of batches."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.root}/data/batch={b['name']}" for b in batches if b.get("rows") != {}]
        if not paths:
            return self.spark.createDataFrame([], schema)
        skip = str(not strict).lower()
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip).parquet(*paths)

    def _latest(self, batches: list[dict], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read(batches)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))  # folders of other buckets are not listed for reading
        if len(batches) < 2:
            return rows.drop("batch", "bucket")
        place = F.array_position(F.array(*[F.lit(b["name"]) for b in batches]), F.col("batch"))
        last = rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*self.value.names), place).alias("v"))
        return last.select("key", "v.*")

    def put(self, rows: DataFrame, distinct: bool = False) -> int:
        """Adds rows(key, ...) in one version, which is returned; a known key gets the new value. distinct says that no key comes twice."""
        chosen = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).where("key is not null")
        one = chosen if distinct else chosen.groupBy("key").agg(F.min_by(F.struct(*self.value.names), F.to_json(F.struct(*self.value.names), {"ignoreNullFields": "false"})).alias("v")).select("key", "v.*")
        if len(self.manifest()["batches"]) >= BATCHES:
            self.compact()
        batch = self._write(one)
        return self._commit(lambda batches: [*batches, batch])

    def get(self, keys: DataFrame, version: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """keys(key, ...) with found and the columns of the value, null where there is none.

        Only the buckets of the keys are read; among(key), where given, is a table that is known to hold them all and is cheaper to read.
        """
        if clash := (set(self.value.names) | {"found", "bucket"}) & set(keys.columns):
            raise ValueError(f"columns that get() adds: {', '.join(sorted(clash))}")
        manifest = self.manifest(version)
        buckets = sorted(r["b"] for r in (keys if among is None else among).where("key is not null").select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets, at most
        values = self._latest(manifest["batches"], buckets).withColumn("found", F.lit(True))
        return keys.join(values, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def missing(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of keys(key) that have no value."""
        return self.get(keys.select("key").where("key is not null").distinct()).where("not found").select("key")

    def all(self, version: int | None = None) -> DataFrame:
        """(key, ...) of every key."""
        return self._latest(self.manifest(version)["batches"])

    def damaged(self, version: int | None = None) -> DataFrame:
        """(batch, bucket, rows, readable) of the buckets that have lost rows."""
        batches = self.manifest(version)["batches"]
        wanted = [(b["name"], int(k), n) for b in batches for k, n in b["rows"].items()]
        have = self._read(batches).groupBy("batch", "bucket").agg(F.count("*").alias("readable"))
        table = self.spark.createDataFrame(wanted, "batch string, bucket int, rows long")
        return table.join(have, ["batch", "bucket"], "left").withColumn("readable", F.coalesce("readable", F.lit(0))).where("readable <> rows")

    def compact(self) -> int:
        """Makes one batch of all that the last version lists; batches that came meanwhile stay after it."""
        old = self.manifest()["batches"]
        merged, names = self._write(self._latest(old)), {b["name"] for b in old}

        def swap(batches: list[dict]) -> list[dict]:
            if not names <= {b["name"] for b in batches}:
                return batches  # someone else has merged them
            return [merged, *[b for b in batches if b["name"] not in names]]

        return self._commit(swap)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all manifests but the last few and the batches that none of those lists; for times without readers of older versions or writers. Returns the batches deleted."""
        known = self.versions()
        kept = {b["name"] for v in known[-keep:] for b in self.manifest(v)["batches"]}
        for v in known[:-keep]:
            self.fs.delete(self._path("manifests", f"{v:010d}.json"), False)
        gone = [s.getPath() for s in self.fs.listStatus(self._path("data")) if s.getPath().getName().removeprefix("batch=") not in kept] if known else []
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)
