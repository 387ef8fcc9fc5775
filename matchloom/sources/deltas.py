"""A stored catalogue that changes by deltas of its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ledger import Ledger
from .catalogue import Catalogue, classified, indexed, name_keys, synonym_keys, tables_of, text_lines

_INDICES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {"names": (name_keys, "part_id"), "synonyms": (synonym_keys, "leaf_code")}
_LINE = "file long, line_no long, place long, line string, kind string, category string, leaf_code string"
_INDEX = "key string, ref string, key_ord long, ref_ord long"


class Store:
    """A folder with a catalogue's lines, by delta, and its two indices as they are after each.

    A delta is a table of files (file, a number that orders them; value, the whole text, or null: the file is gone). Only
    the files of a delta are parsed. Of the indices, only keys that those files hold or held are worked out again, from
    the lines that are in force; all other rows are taken over. Ordinals begin with the file's number, so
    they stay what one parse of all files would give, whatever the order of deltas.

    A delta is entered in a ledger when all of it is written, so one that was lost half-way is as if it had not been.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ledger = spark, path, Ledger(spark, path)

    def versions(self) -> list[int]:
        return self.ledger.entered()

    def apply(self, delta: DataFrame) -> int:
        """Take in a delta; the number of the version that it makes."""
        version = max(self.versions(), default=-1) + 1
        texts = delta.select(F.col("file").cast("long").alias("file"), "value")
        marks = texts.select("file", F.lit("file").alias("kind"))
        parsed = classified(text_lines(texts.filter("value is not null")))
        self.ledger.write_rows(parsed.unionByName(marks, allowMissingColumns=True), version)
        fresh = self.spark.read.schema(_LINE).parquet(self.ledger.rows_at(version))
        before, files = self.lines(), fresh.filter("kind = 'file'").select("file").distinct()
        # a broadcast of file numbers is bounded by the delta; Spark picks it by size
        now = before.join(files, "file", "left_anti").unionByName(fresh.filter("kind is null or kind <> 'file'"))
        gone = before.join(files, "file", "left_semi")
        for name, (keys, _) in _INDICES.items():
            touched = keys(gone).select("key").unionByName(keys(fresh).select("key")).distinct()
            kept = self._index(name).join(touched, "key", "left_anti")
            again = indexed(keys(now).join(touched, "key", "left_semi"))
            kept.unionByName(again).write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")
        self.ledger.enter(version)
        return version

    def lines(self) -> DataFrame:
        """The classified lines in force: of each file, those of its last delta."""
        rows = self.ledger.read(_LINE)
        last = rows.filter("kind = 'file'").groupBy("file").agg(F.max("batch").alias("batch"))
        return rows.filter("kind is null or kind <> 'file'").join(last, ["file", "batch"], "left_semi").drop("batch")

    def _index(self, name: str) -> DataFrame:
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], _INDEX)
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/{name}/{versions[-1]}")

    def catalogue(self) -> Catalogue:
        """The catalogue after all deltas so far."""
        found = tables_of(self.lines())
        for name, (_, ref) in _INDICES.items():
            setattr(found, name, self._index(name).withColumnRenamed("ref", ref))
        return found
