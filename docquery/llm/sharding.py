"""Sharding by size-tiered compaction.

Arrivals become small immutable Parquet shards. A shard's tier is the logarithm of its size, to the base FAN_IN.
Where FAN_IN shards or more of a tier are smaller than half the target size, they are read and written again as files of about the
target size, without a shuffle; tiers are done from small to large until none is full. Every change is a new
version: its shard list is written as Parquet, then one small file, renamed into place without overwriting,
makes it visible. So readers see whole versions, and of two writers with the same base one fails. An arrival may have
other columns than those before; a version has all of them, in the order in which they came, and older rows have nulls there.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path

TARGET_BYTES, FAN_IN, SMALLEST_BYTES = 128 << 20, 4, 1 << 20
ENTRY = "path string, bytes bigint, tier int"


#: Age in seconds below which vacuum leaves files and superseded versions alone: a writer may be about to commit, a reader be at work.
RETENTION = 7 * 24 * 3600


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class SchemaError(TypeError):
    """An arrival has another type for a column than the table."""


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, by name without regard to case; SchemaError if a column has two types."""
    known = {f.name.lower(): f for f in old}
    for f in new:
        mine = known.setdefault(f.name.lower(), f)
        if mine.dataType != f.dataType:
            raise SchemaError(f"column {f.name} is {mine.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in known.values()])


class ShardStore:
    """A table of shards below ``root``, a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, smallest_bytes: int = SMALLEST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan_in, self.smallest = target_bytes, fan_in, smallest_bytes
        self.done = target_bytes // 2  # merged shards come out a little smaller or larger than the target; these are not merged again
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """Committed versions in order."""
        at = self._path("versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _read_commit(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"versions/{version:020d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, tier) of the shards of a version, the latest if none is given."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/{self._read_commit(version)['manifest']}")

    def commit(self, shards: DataFrame, schema: T.StructType, base: int) -> int:
        """Makes version base + 1 of the shards; ConflictError if another writer was first."""
        name = f"manifests/{uuid.uuid4().hex}"
        shards.select("path", "bytes", "tier").coalesce(1).write.parquet(f"{self.root}/{name}")
        draft, final = self._path(f"versions/draft-{uuid.uuid4().hex}"), self._path(f"versions/{base + 1:020d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "manifest": name, "schema": schema.json()}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise ConflictError(f"version {base + 1} exists") from error
        return base + 1

    def _tier(self, size):
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / F.lit(self.smallest)) / math.log(self.fan_in))).cast("int")

    def _write(self, df: DataFrame, **options) -> DataFrame:
        """Writes new shards; returns their entries."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(at)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at)  # names and sizes only
        return files.select("path", F.col("length").alias("bytes"), self._tier(F.col("length")).alias("tier"))

    def _schema(self, version: int) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._read_commit(version)["schema"]))

    def append(self, df: DataFrame, shard_rows: int = 5000) -> int:
        """Adds an arrival as shards of up to shard_rows rows (at least one for each partition with rows). SchemaError if a column has another type than before."""
        base = (self.versions() or [0])[-1]
        schema = merged_schema(self._schema(base) if base else T.StructType(), df.schema)
        new = self._write(df, maxRecordsPerFile=shard_rows)
        return self.commit(self.manifest(base).unionByName(new), schema, base)

    def compact(self) -> int:
        """Merges full tiers, from small to large, until none is full; returns the latest version."""
        tier = 0
        while True:
            base = (self.versions() or [0])[-1]
            shards = self.manifest(base)
            full = shards.where((F.col("tier") >= tier) & (F.col("bytes") < self.done)).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            found = full.where(F.col("n") >= self.fan_in).orderBy("tier").first()
            if not found:
                return base
            tier = found["tier"]
            schema = self._schema(base)
            run = shards.where((F.col("tier") == tier) & (F.col("bytes") < self.done))
            paths = [r.path for r in run.select("path").orderBy("path").toLocalIterator()]  # names of files, as any scan needs them
            merged = self._write(self.spark.read.schema(schema).parquet(*paths).coalesce(max(1, round(found["bytes"] / self.target))))
            self.commit(shards.join(run.select("path"), "path", "left_anti").unionByName(merged), schema, base)
            tier += 1  # merged shards are larger; what they add to higher tiers is looked at there

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the latest if none is given."""
        version = version or (self.versions() or [0])[-1]
        if version == 0:
            raise ValueError("the store is empty")
        schema = self._schema(version)
        paths = [r.path for r in self.manifest(version).select("path").orderBy("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Deletes versions that were superseded more than ``retention`` seconds ago and shards that no version left names and that are
        as old; returns the number of deleted shards. With 0 nobody else may write or read older versions meanwhile."""
        versions, before = self.versions(), (time.time() - retention) * 1000
        if not versions:
            return 0
        made = {v: self._fs.getFileStatus(self._path(f"versions/{v:020d}")).getModificationTime() for v in versions}
        gone = [v for v, after in zip(versions, versions[1:]) if made[after] <= before]
        left = [v for v in versions if v not in gone]
        named = {r.path.rsplit("/data/", 1)[-1] for v in left for r in self.manifest(v).select("path").toLocalIterator()}
        for version in gone:
            self._fs.delete(self._path(f"versions/{version:020d}"), False)
        deleted, files = 0, self._fs.listFiles(self._path("data"), True)
        stale = []
        while files.hasNext():
            status = files.next()
            path = status.getPath()
            if path.getName().startswith("part-") and status.getModificationTime() <= before and path.toString().rsplit("/data/", 1)[-1] not in named:
                stale.append(path)
        for path in stale:
            deleted += bool(self._fs.delete(path, False))
        return deleted


def compacted(docs: DataFrame, root: str, shard_rows: int = 5000, **sizes) -> DataFrame:
    """docs after arrival as small shards, compaction and vacuum of a new store at root, which must have no other user. All rows and columns, whatever their names, nulls and
    repeated rows are kept as they are; no rows give no rows."""
    store = ShardStore(docs.sparkSession, root, **sizes)
    store.append(docs, shard_rows)
    store.compact()
    store.vacuum(retention=0)
    return store.read()


def op1_query(spark, sf_dir: str) -> DataFrame:
    """All documents, read from their compacted shards, with a digest of each text."""
    table = compacted(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "shards"))
    return table.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE = "select doc_id, lang, source, n_chars, sha256(text) text_sha256 from documents"
