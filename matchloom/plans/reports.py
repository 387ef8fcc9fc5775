"""Derived reports and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.categories import ambiguous_words, grouped_index, index_meta
from ..sources.catalogue import Catalogue


def canonical_names(catalogue: Catalogue) -> DataFrame:
    """leaf_ord, part_ord, heading, category, subcategory, part_id, name_az: the report's rows in order.

    heading marks rows that start a new category. A leaf without parts has a row with a null part.
    """
    members = catalogue.members.join(catalogue.parts.select("part_id", "name_az"), "part_id")
    rows = catalogue.leaves.join(members, "leaf_code", "left").select("leaf_ord", F.col("pos").alias("part_ord"), "category", "subcategory", "part_id", "name_az")
    leaf = catalogue.leaves.select("leaf_ord", F.lag("category").over(Window.orderBy("leaf_ord")).alias("before"))
    first = F.row_number().over(Window.partitionBy("leaf_ord").orderBy("part_ord")) == 1
    heading = first & (F.col("before").isNull() | (F.col("before") != F.col("category")))
    return rows.join(leaf, "leaf_ord").withColumn("heading", heading).drop("before").orderBy("leaf_ord", "part_ord")


def canonical_lines(catalogue: Catalogue, title: str = "# Canonical names", note: str = "> Generated; do not edit by hand.") -> DataFrame:
    """line_no and line of the report as Markdown."""
    rows = canonical_names(catalogue)
    n = catalogue.counts().first()
    head = [title, "", note, f"> {n['n_parts']} parts · {n['n_leaves']} leaves.", ""]
    first = F.row_number().over(Window.partitionBy("leaf_ord").orderBy("part_ord")) == 1
    last = F.row_number().over(Window.partitionBy("leaf_ord").orderBy(F.desc("part_ord"))) == 1
    none = F.array().cast("array<string>")
    some = lambda cond, *lines: F.when(cond, F.array(*lines)).otherwise(none)
    lines = F.concat(
        some(F.col("heading"), F.concat(F.lit("## "), "category"), F.lit("")),
        some(first, F.concat(F.lit("### "), "subcategory"), F.lit(""), F.lit("| ID | Canonical Name (AZ) |"), F.lit("|----|---------------------|")),
        some(F.col("part_id").isNotNull(), F.concat(F.lit("| "), "part_id", F.lit(" | "), "name_az", F.lit(" |"))),
        some(last, F.lit("")),
    )
    body = rows.withColumn("lines", lines).select("leaf_ord", "part_ord", F.posexplode("lines").alias("k", "line"))
    order = F.row_number().over(Window.orderBy("leaf_ord", "part_ord", "k")) + len(head) - 1
    top = catalogue.leaves.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    whole = top.unionByName(body.select(order.cast("int").alias("line_no"), "line"))
    end = whole.filter("line <> ''").agg(F.max("line_no")).first()[0]
    return whole.filter(F.col("line_no") <= end).orderBy("line_no")


def report_text(catalogue: Catalogue, **names) -> str:
    """The report as one text, with a line end behind the last line."""
    return "".join(f"{line}\n" for (line,) in canonical_lines(catalogue, **names).select("line").collect())


def index_text(index: DataFrame) -> str:
    """The category index as its file has it: an indent of one, and a line end behind the last line."""
    return json.dumps(json.loads(index_document(index).first()["value"]), ensure_ascii=False, indent=1) + "\n"


def index_document(index: DataFrame) -> DataFrame:
    """One row, value: the category index as a JSON text {index, ambiguous_words, meta}.

    The index of a catalogue is one document, so it is gathered; indices of any size are better kept long.
    """
    def as_map(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "categories")))).alias(name))

    meta = index_meta(index).select(F.struct("total_words", "ambiguous_count", "categories").alias("meta"))
    joined = as_map(grouped_index(index), "index").join(as_map(ambiguous_words(index), "ambiguous_words")).join(meta)
    return joined.select(F.to_json(F.struct("index", "ambiguous_words", "meta")).alias("value"))


def export(catalogue: Catalogue) -> DataFrame:
    """One row, value: parts, groups and both indices as one JSON text."""
    part = F.struct("name_ru", "name_az", "category", "subcategory", "leaf_code", F.col("side_flag").alias("side"), F.col("position_flag").alias("position"))
    entry = lambda k, order, v: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(order, k, v.alias("v")))), lambda e: F.struct(e[k], e["v"])))
    parts = catalogue.parts.agg(entry("part_id", "part_ord", part).alias("parts"))
    members = catalogue.members.groupBy("leaf_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part_id"))), lambda m: m["part_id"]).alias("part_ids"))
    leaves = catalogue.leaves.join(members, "leaf_code", "left").withColumn("part_ids", F.coalesce("part_ids", F.array().cast("array<string>")))
    groups = leaves.agg(entry("leaf_code", "leaf_ord", F.struct("part_ids")).alias("groups"))

    def inverted(table: DataFrame, ref: str, name: str) -> DataFrame:
        refs = table.groupBy("key", "key_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", ref))), lambda r: r[ref]).alias("refs"))
        return refs.agg(entry("key", "key_ord", F.col("refs")).alias(name))

    whole = parts.join(groups).join(inverted(catalogue.names, "part_id", "name_index")).join(inverted(catalogue.synonyms, "leaf_code", "synonym_index"))
    return whole.select(F.to_json(F.struct("parts", "groups", "name_index", "synonym_index"), {"ignoreNullFields": "false"}).alias("value"))
