"""Content hashes, change detection, versions, and publishing a snapshot without ever showing half of it.

The stored table has file_name, file_hash, file_size, version and any payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def latest(stored: DataFrame) -> DataFrame:
    """The highest version's row of each file: one partial aggregate, no window."""
    rest = [c for c in stored.columns if c not in ("file_name", "version")]
    top = stored.groupBy("file_name").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("r"))
    return top.select("file_name", "version", "r.*")


def change_status(incoming: DataFrame, stored: DataFrame, with_size: bool = True, force: bool = False) -> DataFrame:
    """incoming with status new, changed or unchanged, against the latest stored version."""
    old = latest(stored.select("file_name", "file_hash", "file_size", "version")).select("file_name", F.col("file_hash").alias("_h"), F.col("file_size").alias("_s"), F.col("version").alias("_v"))
    same = (F.col("file_hash") == F.col("_h")) & F.lit(not force)
    if with_size:
        same &= F.col("file_size") == F.col("_s")
    status = F.when(F.col("_v").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return incoming.join(old, "file_name", "left").withColumn("status", status).drop("_h", "_s", "_v")


def next_version(names: DataFrame, stored: DataFrame) -> DataFrame:
    """file_name, next_version: one past the highest stored, 1 for a new file."""
    top = stored.groupBy("file_name").agg(F.max("version").alias("_v"))
    return names.select("file_name").distinct().join(top, "file_name", "left").select("file_name", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version"))


def processed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("file_name", "file_hash").distinct(), ["file_name", "file_hash"], "left_semi")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def remove(stored: DataFrame, names: DataFrame, by_base: bool = False) -> DataFrame:
    """stored without the named files; by_base: without those whose names agree up to the last extension."""
    if not by_base:
        return stored.join(names.select("file_name"), "file_name", "left_anti").select(stored.columns)
    gone = names.select(base_name(F.col("file_name")).alias("_b")).distinct()
    return stored.withColumn("_b", base_name(F.col("file_name"))).join(gone, "_b", "left_anti").select(stored.columns)


def swap(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after each fresh file has replaced its stored rows."""
    return remove(stored, fresh.select("file_name").distinct()).unionByName(fresh)


def summary(status: DataFrame) -> DataFrame:
    """source, new, updated, skipped, failed, segments."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("source").agg(n("new").alias("new"), n("changed").alias("updated"), n("unchanged").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"))


class SnapshotTable:
    """A table of Parquet snapshots; readers follow the newest published marker, so a failed write changes nothing.

    A snapshot is whole once its marker (a Parquet row of its own, written last) exists.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by

    def current(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/published").agg(F.max("snapshot")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self) -> DataFrame | None:
        n = self.current()
        return self.spark.read.parquet(f"{self.path}/snapshots/{n}") if n else None

    def publish(self, df: DataFrame) -> int:
        n = self.current() + 1
        df.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.path}/snapshots/{n}")
        self.spark.createDataFrame([(n,)], "snapshot long").coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return n

    def swap(self, fresh: DataFrame) -> int:
        old = self.read()
        return self.publish(fresh if old is None else swap(old, fresh))
