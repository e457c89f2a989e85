"""Where tables come from: Parquet folders, catalog tables, or a folder of versioned tables.

A versioned table is a list of Parquet folders of rows and of deleted ids, each row with the version that added it, read by one scan each: rows of an older
version whose id was deleted later are left out by an anti-join. One manifest names all folders of all tables; a commit writes the
next manifest under a name that must not exist. So a commit costs what it changes, and ``compact`` rewrites a table.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ParquetTables:
    """Read-only tables of a folder, ``<root>/<name>.parquet``; qualified names and those in ``catalog`` are of the catalog."""

    def __init__(self, spark: SparkSession, root: str, catalog: set[str] | None = None):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), set(catalog or ())

    def latest(self) -> None:
        return None

    def read(self, name: str, version: Any = None) -> DataFrame:
        if "." in name or name in self.catalog:
            return self.spark.table(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


class CommitConflictError(RuntimeError):
    """Another transaction has committed since this one began."""


class VersionedTables:
    """Tables below ``root``, a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.root}/{name}")
        self._fs = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._path("manifests").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_options = lambda: spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def latest(self) -> int:
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"manifests/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self, name: str, version: int | None = None) -> bool:
        return name in self.manifest(self.latest() if version is None else version)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(self.latest() if version is None else version).get(name)
        if entry is None:
            raise KeyError(f"no table {name}")
        return self._rows(entry)

    def _rows(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["rows"]:
            return self.spark.createDataFrame([], schema)
        rows = self._scan(entry["rows"], schema.add("__v", T.LongType()))
        if entry["deleted"]:
            gone = self._scan(entry["deleted"], T.StructType([T.StructField("__id", T.StructType.fromJson(entry["schema"])[entry["id"]].dataType), T.StructField("__v", T.LongType())]))
            gone = gone.groupBy("__id").agg(F.max("__v").alias("__deleted"))
            rows = rows.join(gone, (F.col(f"`{entry['id']}`") == F.col("__id")) & (F.col("__v") < F.col("__deleted")), "left_anti")
        return rows.drop("__v")

    def _scan(self, parts: list[str], schema: T.StructType) -> DataFrame:
        """One scan of all parts; __v is the version that wrote a row."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def _write(self, df: DataFrame, version: int) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.withColumn("__v", F.lit(version).cast("bigint")).write.parquet(f"{self.root}/{name}")
        return name

    def commit(self, base: int, changes: dict[str, dict[str, Any]]) -> int:
        """changes: table to {"id", "schema", "rows": DataFrame or None, "deleted": DataFrame of ids or None, "replace": bool}."""
        version, tables = base + 1, self.manifest(base)
        for name, change in changes.items():
            entry = {"id": change["id"], "schema": change["schema"].jsonValue(), "rows": [], "deleted": []}
            if name in tables and not change.get("replace"):
                entry |= {"rows": list(tables[name]["rows"]), "deleted": list(tables[name]["deleted"])}
            if change.get("deleted") is not None:
                entry["deleted"].append(self._write(change["deleted"], version))
            if change.get("rows") is not None:
                entry["rows"].append(self._write(change["rows"], version))
            tables[name] = entry
        draft = self._path(f"manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(f"manifests/{version:012d}"), self._no_options())
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise CommitConflictError(f"version {version} exists") from error
        return version

    def compact(self, name: str) -> int:
        """Rewrites a table without its deleted rows."""
        base = self.latest()
        entry = self.manifest(base)[name]
        return self.commit(base, {name: {"id": entry["id"], "schema": T.StructType.fromJson(entry["schema"]), "rows": self._rows(entry), "replace": True}})
