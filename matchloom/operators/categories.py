"""The category index and the resolution of words to categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import passthrough
from ..functions.text import round3
from ..sources.catalogue import Catalogue
from .matching import Asked
from .near import PAIR, NearIndex, near_keys, small

# Fixed value: the question that goes with an ambiguous category.
QUESTION = "К какой категории относится деталь?"
LEAST_CONTAINED = 3


def category_index(catalogue: Catalogue) -> DataFrame:
    """key and category, each pair once: of part names and their parts, and synonyms and their leaves."""
    parts, leaves = catalogue.parts.select("part_id", "category"), catalogue.leaves.select("leaf_code", "category")
    names = catalogue.names.join(parts, "part_id").select("key", "category")
    return names.unionByName(catalogue.synonyms.join(leaves, "leaf_code").select("key", "category")).distinct()


def grouped_index(index: DataFrame) -> DataFrame:
    """key and its categories, sorted."""
    return index.groupBy("key").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def ambiguous_words(index: DataFrame) -> DataFrame:
    return grouped_index(index).filter(F.size("categories") > 1)


def index_meta(index: DataFrame) -> DataFrame:
    """One row: total_words, ambiguous_count, and all categories, sorted."""
    words = grouped_index(index).agg(F.count(F.lit(1)).alias("total_words"), F.count_if(F.size("categories") > 1).alias("ambiguous_count"))
    return words.join(index.agg(F.array_sort(F.collect_set("category")).alias("categories")))


def _grams(text: Column) -> Column:
    """The distinct stretches of three characters of a text."""
    ends = F.greatest(F.length(text) - LEAST_CONTAINED + 1, F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), ends), lambda k: F.substring(text, k, F.lit(LEAST_CONTAINED)))
    return F.when(F.length(text) >= LEAST_CONTAINED, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def contained(keys: DataFrame, grouped: DataFrame, rows: int) -> DataFrame:
    """key and the categories of all index keys that contain it (keys of three characters or more).

    Whatever contains a key has all its trigrams. So a key meets only the index keys that have the rarest
    of them (by the number of index keys it is in; the first of those equally rare), and is then looked for as a whole. A key with a trigram
    that the index has not is in none. rows: index rows by trigram, at most.
    """
    index = grouped.select(F.col("key").alias("found"), "categories", F.explode(_grams(F.col("key"))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = keys.select("key").distinct().select("key", F.explode(_grams(F.col("key"))).alias("gram"))
    rare = asked.join(small(often, rows), "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    met = rare.filter("least.n > 0").select("key", F.col("least.gram").alias("gram")).join(small(index, rows), "gram").filter(F.contains("found", "key"))
    return met.select("key", F.explode("categories").alias("category")).groupBy("key").agg(F.array_sort(F.collect_set("category")).alias("contained"))


def resolve_categories(words: DataFrame, index: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Add result, a category_result struct, to a table of words.

    words has qid and word, and may have raw_text and threshold; index has key and category. An exact key
    decides, then the nearest keys at the threshold, then all keys that contain the word. What only
    contains the word is always ambiguous, even with one category. Null words are unknown.

    All columns stay, whatever their names; only those named result give way to the new one. raw_text and threshold are there as
    they were used.
    """
    asked = Asked(words, "word")
    out = resolved(asked, index, asked.pairs() if pairs is None else pairs)
    return asked.put_back(out, {"raw_text": None, "threshold": None, "result": "category_result"})


def resolved(asked: Asked, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of asked with category_result."""
    grouped = grouped_index(index)
    near_index = NearIndex(grouped.select("key", F.lit(0).alias("key_ord"), F.lit(3).alias("tier")))
    rows, _, longest, *_ = near_index.sizes()
    exact = pairs.join(small(grouped, rows), "key").select(*PAIR, F.lit(1.0).alias("score"), "categories")
    rest = pairs.join(small(grouped.select("key"), rows), "key", "left_anti")
    found = near_keys(rest, near_index, asked.deep(near_index)).join(small(grouped.withColumnRenamed("key", "found"), rows), "found")
    near = found.select(*PAIR, "score", F.explode("categories").alias("category")).groupBy(*PAIR, "score").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    # what contains a key counts only where nothing is near it
    inexact = rest.join(near, PAIR, "left").join(contained(rest, grouped, rows * max(1, longest)), "key", "left")
    known = exact.unionByName(inexact.select(*PAIR, "score", F.coalesce("categories", "contained").alias("categories")).filter("categories is not null"))
    out = asked.rows.join(known, PAIR, "left")
    cats, by_score = F.when(F.col("phrase").isNotNull(), F.col("categories")), F.col("score").isNotNull()
    one = by_score & (F.size(cats) == 1)
    several = cats.isNotNull() & ~one
    result = F.struct(
        F.when(cats.isNull(), "category_unknown").when(one, "category_resolved").otherwise("category_ambiguous").alias("status"),
        F.when(one, F.get(cats, F.lit(0))).alias("category"),
        F.when(several, cats).alias("candidates"),
        F.when(several, F.lit(QUESTION)).alias("question"),
        passthrough(F.col("phrase"), F.col("raw_text")).alias("raw_text_passthrough"),
        F.when(cats.isNotNull(), round3(F.col("score"))).alias("match_score"),
        F.when(several & ~by_score, F.lit("containment")).alias("matched_by"),
    )
    return out.withColumn("category_result", result).drop("categories", "score")


def resolve_one(index: DataFrame, word: str, raw_text: str | None = None, threshold: float = 0.90) -> dict:
    """One word's result as a dictionary, without what is null."""
    row = index.sparkSession.createDataFrame([(0, word, raw_text, threshold)], "qid long, word string, raw_text string, threshold double")
    out = resolve_categories(row, index).first()["result"].asDict(recursive=True)
    return {k: v for k, v in out.items() if v is not None}
