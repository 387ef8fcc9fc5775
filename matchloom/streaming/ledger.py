"""A sink of micro-batches that takes each one once, whatever is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """A folder with the rows of each batch and a ledger of the batches that are whole.

    A batch is written to a folder of its own and then entered in the ledger. One that comes again is left
    out if it is entered; if it is not, its folder is written anew. Readers see entered batches only.
    So a driver may be lost between any two steps: the stream runs the batch again under the same number, from the same input.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def entered(self) -> list[int]:
        """The batches that are whole, in order."""
        files, where = self._at("ledger")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where)) if files.exists(where) else []

    def rows_at(self, batch: int) -> str:
        return f"{self.path}/rows/{batch}"

    def write_rows(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.rows_at(batch))

    def enter(self, batch: int) -> None:
        files, where = self._at("ledger", str(batch))
        files.createNewFile(where)

    def take(self, rows: DataFrame, batch: int) -> None:
        """What foreachBatch calls."""
        files, where = self._at("ledger", str(batch))
        if not files.exists(where):
            self.write_rows(rows, batch)
            self.enter(batch)

    def read(self, schema) -> DataFrame:
        """The rows of all entered batches, with their batch."""
        paths = [self.rows_at(b) for b in self.entered()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.select("*", F.regexp_extract("_metadata.file_path", "/rows/(\\d+)/", 1).cast("long").alias("batch"))
