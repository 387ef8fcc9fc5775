"""Line dedup with levelled sorted runs of line hashes, on DataFrame functions alone.

Documents come in batches of descending ids. A run is a table of line hashes, bucketed and sorted by hash,
with the document that keeps each line. A batch is merge-anti-joined with the runs: lines that no run has
yet are new, the largest id that holds them is in this batch, and they make a run of their own. When a
level has as many runs as the fan-out, they are merged into one of the next level. All runs and batches
are bucketed alike, so neither the anti-joins nor the merges move rows between tasks.

Lines of enough documents are then dropped from all documents but the one that their run names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Buckets, remove, scratch, written

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def line_hash(key: Column) -> Column:
    """128 bits of a key, as two independent hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """The levelled runs: tables of h1, h2 and keeper, each line in one run only. Batches are tables of self.buckets."""

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out, self.buckets = spark, fan_out, Buckets(spark, HASH)
        self.levels: list[list[str]] = [[]]

    @property
    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The lines of a batch that no run has."""
        for name in self.names:
            batch = batch.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, keeper, each line once) of lower ids than those before. Full levels are merged."""
        self.levels[0].append(self.buckets.write(self.fresh(batch).select(*HASH, "keeper"), aligned=bool(self.names)))
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fan_out:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[k] = self.levels[k], []
            self.levels[k + 1].append(self.buckets.write(self._merged(old), aligned=True))
            self.buckets.drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("keeper", "later").hint("merge")
            out = out.join(other, HASH, "full_outer").select(*HASH, F.coalesce("later", "keeper").alias("keeper"))
        return out

    def lines(self) -> DataFrame:
        """Every line with its keeper."""
        out = self.spark.createDataFrame([], "h1 long, h2 long, keeper long")
        for name in self.names:
            out = out.unionByName(self.spark.table(name))
        return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """id_col (as doc_id), n_lines, n_dropped and kept_text of every document.

    A line's key is the line without white space at both ends, ASCII letters lower-cased. Keys of at least
    min_chars code points that at least min_docs documents hold are dropped from all of them but the one
    with the largest id. A null or empty text is one empty line. Rows that share an id count as one document;
    those that share the largest id all keep the line. Null is an id below all others. An empty table gives
    no row, and other columns are left out, whatever their names.

    Texts are read once for the runs (in batches of about equally many rows by id) and once for the drop,
    and shuffled once, by document. A line's documents are counted before the shuffle by line, so a line
    that a third of all documents hold costs a row a task; the join that finds its places is one that can be
    split by skew.
    """
    spark = docs.sparkSession
    low = F.lit(-(2**63))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce("doc_id", low)
    # any bounds will do: all rows of an id are in one batch, and batches go from the largest ids down
    bounds = rows.agg(F.percentile_approx(held, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = sum((F.when(held <= b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    known = rows.select(
        held.alias("keeper"),
        batch.alias("batch"),
        F.explode(F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars))).alias("key"),
    )
    each = known.select("keeper", "batch", line_hash(F.col("key")).alias("h")).select("batch", "h.h1", "h.h2", "keeper").distinct()
    counted = each.groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("keeper").alias("keeper"))
    runs = LineRuns(spark, fan_out)
    try:
        batched = runs.buckets.write(counted, "batch")
        for k in range(batches):
            runs.add(spark.table(batched).filter(F.col("batch") == k).select(*HASH, "keeper"))
        often = spark.table(batched).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs).select(*HASH)
        # written first: a join of two tables as they are can be split where a line is in very many documents
        dropped, _ = written(often.join(runs.lines(), HASH), "dropped")
    finally:  # no table name is left behind, whatever failed
        runs.buckets.drop(list(runs.buckets.paths))
    row = [held.alias("row_id"), F.xxhash64("text").alias("row_hash")]
    placed = rows.select(*row, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key")).filter(F.char_length("key") >= min_chars)
    placed = placed.select("row_id", "row_hash", "at", line_hash(F.col("key")).alias("h")).select("row_id", "row_hash", "at", "h.h1", "h.h2")
    gone = placed.join(dropped, HASH).filter(F.col("row_id") < F.col("keeper"))
    gone = gone.groupBy("row_id", "row_hash").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    both = rows.select("*", *row).join(gone, ["row_id", "row_hash"], "left")
    lines, cut = F.col("lines"), F.coalesce("gone", F.array().cast("array<int>"))
    both = both.select("doc_id", lines_of(F.col("text")).alias("lines"), cut.alias("gone"))
    # what stays are the stretches between the places that go
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    stay = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice(lines, F.get("edges", k) + 2, F.get("edges", k + 1) - F.get("edges", k) - 1))
    both = both.withColumn("edges", edges)
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.flatten(stay), "\n").alias("kept_text"))


