"""Other sources and sinks: the category index as JSON, results as JSON, reports as text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (without one, on a local master, in a temporary folder), removed when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_matchloom_files", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._matchloom_files = f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
    path = f"{found}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if the session or the path is gone."""
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is None or jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def write_category_index(index: DataFrame, path: str) -> None:
    """The category index as a folder with one JSON file."""
    from ..plans.reports import index_text

    text = index_text(index).removesuffix("\n")
    index.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


@dataclass
class IndexDocument:
    """index(key, category), ambiguous(key, category) and meta(total_words, ambiguous_count, category; a row for each category) of a JSON category index."""

    index: DataFrame
    ambiguous: DataFrame
    meta: DataFrame

    def mismatches(self) -> DataFrame:
        """what, said and found: where a document's other two parts are not what its index says. No row: it is whole."""
        count = lambda df, what: df.agg(F.count_distinct("key").cast("string").alias("found")).select(F.lit(what).alias("what"), "found")
        names = lambda df: df.agg(F.to_json(F.array_sort(F.collect_set("category"))).alias("found"))
        often = self.index.groupBy("key").agg(F.count_distinct("category").alias("n")).filter("n > 1").select("key")
        found = count(self.index, "total_words").unionByName(count(often, "ambiguous_count")).unionByName(names(self.index).select(F.lit("categories").alias("what"), "found"))
        first = lambda c: F.max(F.col(c)).cast("string")
        said = self.meta.agg(F.map_from_arrays(F.array(F.lit("total_words"), F.lit("ambiguous_count"), F.lit("categories")), F.array(first("total_words"), first("ambiguous_count"), F.to_json(F.array_sort(F.collect_set("category"))))).alias("m"))
        counts = found.join(said.select(F.explode("m").alias("what", "said")), "what").filter(~F.col("said").eqNullSafe(F.col("found"))).select("what", "said", "found")
        should = self.index.join(often, "key").select("key", "category", F.lit(True).alias("should"))
        words = self.ambiguous.withColumn("is_there", F.lit(True)).join(should, ["key", "category"], "full").filter("should is null or is_there is null")
        side = lambda flag: F.when(F.col(flag), F.col("category"))
        return counts.unionByName(words.select(F.concat(F.lit("ambiguous_words: "), "key").alias("what"), side("is_there").alias("said"), side("should").alias("found")))


def read_index(spark: SparkSession, path: str) -> IndexDocument:
    """All of a JSON category index. Its words are read out of the document as a variant, so they need no schema of their own."""
    document = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))

    def entries(name: str) -> DataFrame:
        part = F.variant_get(F.col("v").outer(), f"$.{name}", "variant")
        each = document.lateralJoin(spark.tvf.variant_explode(part)).select("key", F.col("value").cast("array<string>").alias("categories"))
        return each.select("key", F.explode("categories").alias("category"))

    said = lambda name, kind: F.variant_get("v", f"$.meta.{name}", kind).alias(name)
    meta = document.select(said("total_words", "long"), said("ambiguous_count", "long"), F.explode_outer(F.variant_get("v", "$.meta.categories", "array<string>")).alias("category"))
    return IndexDocument(entries("index"), entries("ambiguous_words"), meta)


def read_category_index(spark: SparkSession, path: str) -> DataFrame:
    """key and category of a JSON category index."""
    return read_index(spark, path).index


def result_json(result: Column, score: str = "match_score") -> Column:
    """A result struct as JSON: nulls are written, but for a null score."""
    text = F.to_json(result, {"ignoreNullFields": "false"})
    return F.when(result[score].isNull(), F.regexp_replace(text, f',"{score}":null', "")).otherwise(text)


def write_results(df: DataFrame, path: str) -> None:
    """A table with results as JSON lines."""
    df.write.json(path, ignoreNullFields=False)


def write_text(lines: DataFrame, path: str) -> None:
    """A report (line_no, line) as one text file. Reports are as long as a catalogue, not as a table of phrases."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """part_ord, category, subcategory, part_id, name_az of a canonical-names report."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    order = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = lambda mark: F.last(F.nullif(F.regexp_extract("line", f"^{mark} (.*)$", 1), F.lit("")), ignorenulls=True).over(order)
    rows = lines.select("line_no", "line", heading("##").alias("category"), heading("###").alias("subcategory"))
    row = r"^\| ([A-Z]{2,3}-\d+) \| (.*) \|$"
    return rows.filter(F.col("line").rlike(row)).select(F.col("line_no").alias("part_ord"), "category", "subcategory", F.regexp_extract("line", row, 1).alias("part_id"), F.regexp_extract("line", row, 2).alias("name_az"))
