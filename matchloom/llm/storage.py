"""Shared scratch tables, table reading, and what Python workers need to import."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only a session without one, on a local master, gets a
    temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_matchloom_shared", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
        spark._matchloom_shared = found
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; nothing happens if the session or the path is gone."""
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is None or jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, sort: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Buckets:
    """Scratch tables bucketed and sorted by the same columns, which join each other without an exchange."""

    def __init__(self, spark: SparkSession, columns: list[str]):
        self.spark, self.columns, self.paths = spark, columns, {}
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, *parts: str, aligned: bool = False) -> str:
        """Write a table (in partitions by the columns parts as well); its name for spark.table().

        aligned: df is a join or an aggregation of such tables, and needs no exchange.
        """
        name = f"bucketed_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        dealt = df if aligned else df.repartition(self.count, *self.columns)
        out = dealt.write.option("path", self.paths[name]).option("compression", "zstd")
        (out.partitionBy(*parts) if parts else out).bucketBy(self.count, *self.columns).sortBy(*self.columns).saveAsTable(name)
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
