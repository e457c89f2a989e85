"""Helpers shared by the operators: checkpoints in the shared folder, single evaluation, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode one is made where it is unset, on a cluster that is an error."""
    named, used = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    found = named or used
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docquery-")
    if not used:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, computed, as the side of a join: broadcast if it has at most most_rows rows, else left to a shuffle.

    For narrow tables of one row a group or a language, whose number is usually small but isn't bounded.
    """
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most_rows else df


#: A key is hot if it has over a HOT_SHARE-th of the rows, and more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 256


def hot_keys(rows: DataFrame, keys: str | list[str], counts: str | None = None) -> DataFrame:
    """(keys, tasks): keys with over 1 / HOT_SHARE of the rows, so fewer than HOT_SHARE of them, and how many tasks they are dealt to.

    ``rows`` should be checkpointed; ``counts`` names a column with the number of rows where each key has one row.
    """
    keys = [keys] if isinstance(keys, str) else keys
    sizes = rows.groupBy(*keys).agg(F.sum(counts).alias("n") if counts else F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum(counts), F.lit(0))).first()[0] if counts else rows.count()
    most = max(total // HOT_SHARE, HOT_ROWS)
    return F.broadcast(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("tasks")))


def join_spread(rows: DataFrame, table: DataFrame, keys: str | list[str], by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key by a shuffle. Rows of a hot key are dealt to several tasks by a hash of ``by``, its row of the table is repeated."""
    keys = [keys] if isinstance(keys, str) else keys
    dealt = rows.join(hot, keys, "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64(by), "tasks"), F.lit(0))).drop("tasks")
    repeated = table.join(hot, keys, "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    return dealt.join(repeated, [*keys, "task"], how).drop("task")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a compressed table in the shared folder, for rows with whole texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is. Texts of ASCII only take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
