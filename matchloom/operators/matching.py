"""Tiered matching of tables of phrases against a catalogue.

A phrase is looked up as an exact name, then an exact synonym, then a near name, then a near synonym; the
first tier that gives anything decides. All distinct (key, threshold) pairs are matched once; a pair's
candidates become one array, and phrases are joined to that one row. So phrases are never regrouped, and
the arrays are bounded by the catalogue. Nothing is persisted here: all tiers read the distinct pairs behind
one exchange, which Spark reuses, so streams and repeated calls leave nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import position, search_space, side
from ..functions.text import match_key, round3
from ..sources.catalogue import Catalogue, ordinals
from .columns import Apart
from .near import PAIR, may_be_deep, near_keys, small

THRESHOLD = 0.90


def with_parameters(phrases: DataFrame) -> DataFrame:
    """raw_text, threshold and restrict_category added where they are not there; a null threshold takes its default."""
    kinds = {"raw_text": "string", "threshold": "double", "restrict_category": "string"}
    out = phrases.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in phrases.columns])
    return out.withColumn("threshold", F.coalesce(F.col("threshold").cast("double"), F.lit(THRESHOLD)))


def hits(pairs: DataFrame, catalogue: Catalogue, deep: bool | None = None) -> DataFrame:
    """key, threshold, tier (1 to 4), score, part_id, at (the order of candidates). deep: as in near_keys."""
    sizes = catalogue.sizes()
    lookup = small(catalogue.lookup, sizes["lookup"])
    exact = pairs.join(lookup, "key").select(*PAIR, "tier", F.lit(1.0).alias("score"), "part_id", "at")
    rest = pairs.join(small(catalogue.lookup.select("key"), sizes["lookup"]), "key", "left_anti")
    # both near tiers in one pass: a pair's hits are those of the lower tier that has any
    near = near_keys(rest, catalogue.near, deep).join(small(catalogue.near_refs, sizes["near_refs"]), ["found", "tier"])
    return exact.unionByName(near.select(*PAIR, "tier", "score", "part_id", ordinals("key_ord", "ref_ord", "pos")))


def candidates(pairs: DataFrame, catalogue: Catalogue, deep: bool | None = None) -> DataFrame:
    """key, threshold, tier, score, parts: each pair's candidates in order, each part once, with its columns."""
    found = hits(pairs, catalogue, deep).groupBy(*PAIR, "tier", "score", "part_id").agg(F.min("at").alias("at"))
    full = found.join(small(catalogue.parts, catalogue.sizes()["parts"]), "part_id")
    fields = ["at", "part_id", "name_ru", "name_az", "category", "subcategory", "side_flag", "position_flag"]
    return full.groupBy(*PAIR, "tier", "score").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))


#: Columns of parameters, which come out as they were used.
USED = ("raw_text", "threshold", "restrict_category")


class Asked(Apart):
    """Phrases or words with their parameters, and the distinct pairs that are to be looked up."""

    def __init__(self, table: DataFrame, column: str):
        super().__init__(table)
        threshold = F.coalesce(self.get("threshold", "double"), F.lit(THRESHOLD))
        text = self.column(column)
        self.rows = self.plain.withColumns({"phrase": text, "raw_text": self.get("raw_text", "string"), "threshold": threshold, "restrict_category": self.get("restrict_category", "string"), "key": match_key(F.coalesce(text, F.lit("")))})
        self.said = self.rows.filter("phrase is not null").select(*PAIR)

    def pairs(self) -> DataFrame:
        return self.said.distinct()

    def deep(self, catalogue_index) -> bool:
        """Whether a row needs more of an index than its pieces."""
        return may_be_deep(self.said, F.col("key"), F.col("threshold"), catalogue_index)


def distinct_pairs(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """The distinct (key, threshold) of a table of phrases."""
    return Asked(phrases, column).pairs()


def match(phrases: DataFrame, catalogue: Catalogue, pairs: DataFrame | None = None) -> DataFrame:
    """Add result, a match_result struct, and tier (null without a match) to a table of phrases.

    phrases has qid and phrase, and may have raw_text, threshold (0.9) and restrict_category. The
    restriction comes after the choice of the tier: a phrase whose tier has no part of the category is
    no_match. Null phrases match nothing, and so do thresholds above 1 or NaN, except exactly. Every row stays, repeated qids too. pairs are those of
    distinct_pairs(), if they are known already.

    All columns stay, whatever their names; only those named result or tier give way to the new ones. raw_text, threshold and
    restrict_category are there as they were used.
    """
    asked = Asked(phrases, "phrase")
    out = matched(asked, asked.rows, catalogue, asked.pairs() if pairs is None else pairs)
    return asked.put_back(out, dict.fromkeys(USED) | {"result": "result", "tier": "tier"})


def matched(asked: Asked, rows: DataFrame, catalogue: Catalogue, pairs: DataFrame) -> DataFrame:
    """The rows of asked (which may have more columns by now) with result and tier."""
    joined = rows.join(candidates(pairs, catalogue, asked.deep(catalogue.near)), PAIR, "left")
    empty = F.array().cast(joined.schema["parts"].dataType)
    wanted = F.filter("parts", lambda p: F.col("restrict_category").isNull() | (p["category"] == F.col("restrict_category")))
    chosen = joined.withColumn("parts", F.when(F.col("phrase").isNull(), empty).otherwise(F.coalesce(wanted, empty)))
    return chosen.withColumn("result", _result()).withColumn("tier", F.when(F.size("parts") > 0, F.col("tier"))).drop("parts", "score")


def _result() -> Column:
    part, n = F.get("parts", F.lit(0)), F.size("parts")
    single, none = n == 1, F.lit(None).cast("string")
    text = search_space(F.col("phrase"), F.col("raw_text"))
    found = {"side": F.when(single & part["side_flag"], side(text)), "position": F.when(single & part["position_flag"], position(text))}
    needs = F.filter(F.array(*[F.when(single & part[f"{k}_flag"] & v.isNull(), k) for k, v in found.items()]), lambda x: x.isNotNull())
    several = F.transform(F.when(n > 1, F.col("parts")).otherwise(F.slice("parts", F.lit(1), F.lit(0))), lambda p: F.struct(p["part_id"].alias("part_id"), p["name_ru"].alias("name_ru"), p["name_az"].alias("name_az")))
    return F.struct(
        F.when(n == 0, "no_match").when(single, "single_match").otherwise("ambiguous").alias("status"),
        *[F.when(single, part[c]).otherwise(none).alias(c) for c in ("part_id", "name_ru", "name_az", "category", "subcategory")],
        F.struct(*[v.alias(k) for k, v in found.items()]).alias("attributes"),
        needs.alias("needs_clarification"),
        several.alias("candidates"),
        F.when(n > 0, round3(F.col("score"))).alias("match_score"),
    )


def match_one(catalogue: Catalogue, phrase: str, raw_text: str | None = None, threshold: float = THRESHOLD, restrict_category: str | None = None) -> dict:
    """One phrase's result as a dictionary; match_score is only there with a match."""
    spark = catalogue.parts.sparkSession
    row = spark.createDataFrame([(0, phrase, raw_text, threshold, restrict_category)], "qid long, phrase string, raw_text string, threshold double, restrict_category string")
    out = match(row, catalogue).first()["result"].asDict(recursive=True)
    if out["match_score"] is None:
        del out["match_score"]
    return out
