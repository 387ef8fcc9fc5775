"""Audits of a catalogue and of derived files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import Catalogue

#: Buckets of keys whose fingerprints are compared.
BUCKETS = 4096


def collisions(catalogue: Catalogue) -> DataFrame:
    """key, part_ids and other_leaves of every name that is also a synonym of a leaf none of its parts is in."""
    owned = catalogue.names.join(catalogue.parts.select("part_id", "leaf_code"), "part_id").select("key", "part_id", "leaf_code")
    others = catalogue.synonyms.select("key", "leaf_code").join(owned.select("key", "leaf_code").distinct(), ["key", "leaf_code"], "left_anti")
    named = owned.groupBy("key").agg(F.array_sort(F.collect_set("part_id")).alias("part_ids"))
    return others.groupBy("key").agg(F.array_sort(F.collect_set("leaf_code")).alias("other_leaves")).join(named, "key").select("key", "part_ids", "other_leaves").orderBy("key")


def fingerprints(table: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows, total and mixed: what a table is, bucket by bucket of its keys, whatever the order of its rows.

    A few thousand rows stand for a table of any size; they can be kept next to a derived file instead of the file being
    read again. Repeated rows count. Columns are taken by name, so their order does not matter.
    """
    columns = [F.col(f"`{c}`") for c in sorted(table.columns)]
    # a null is told from an empty text by its own flag
    told = [x for c in columns for x in (c, c.isNull())]
    rows = table.select(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("bucket"), F.xxhash64(*told).alias("one"), F.xxhash64(F.lit(7), *told).alias("other"))
    total = F.sum(F.col("one").cast("decimal(38,0)"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), total.alias("total"), F.bit_xor("other").alias("mixed"))


def differing(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """The buckets in which two tables of fingerprints differ."""
    said = lambda df, p: df.select("bucket", F.struct("rows", "total", "mixed").alias(p))
    return said(held, "held").join(said(fresh, "fresh"), "bucket", "full").filter(~F.col("held").eqNullSafe(F.col("fresh"))).select("bucket")


def staleness(held: DataFrame, fresh: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row: stale, and in how many buckets the tables differ."""
    found = differing(fingerprints(held, keys, buckets), fingerprints(fresh, keys, buckets))
    return found.agg((F.count(F.lit(1)) > 0).alias("stale"), F.count(F.lit(1)).alias("differing"))


def changes(held: DataFrame, fresh: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The keys and change ("added", "changed" or "lost") of all that is not in both tables alike.

    Only buckets whose fingerprints differ are compared row by row. Keys may be null and rows repeated: a key has
    changed if the rows that have it are not the same, counted.
    """
    which = differing(fingerprints(held, keys, buckets), fingerprints(fresh, keys, buckets)).withColumnRenamed("bucket", "_bucket")
    columns = sorted(held.columns)
    names = [f"_k{n}" for n in range(len(keys))]

    def sorted_rows(table: DataFrame, side: str) -> DataFrame:
        asked = table.select(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("_bucket"), *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
        counted = asked.join(which, "_bucket", "left_semi").groupBy(*names, "_row").agg(F.count(F.lit(1)).alias("_n"))
        return counted.select(*names, "_row", F.col("_n").alias(side))

    old, new = sorted_rows(held, "_old"), sorted_rows(fresh, "_new")
    same = [old[n].eqNullSafe(new[n]) for n in (*names, "_row")]
    kept = [F.coalesce(old[n], new[n]).alias(n) for n in names]
    both = old.join(new, _all(same), "full").select(*kept, "_old", "_new")
    told = both.groupBy(*names).agg(F.max(F.col("_old").isNotNull()).alias("was"), F.max(F.col("_new").isNotNull()).alias("now_"), F.max(~F.col("_old").eqNullSafe(F.col("_new"))).alias("differs"))
    change = F.when(~F.col("was"), "added").when(~F.col("now_"), "lost").otherwise("changed")
    return told.filter("differs").select(*[F.col(n).alias(k) for n, k in zip(names, keys)], change.alias("change"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def stale(current: DataFrame, fresh: DataFrame) -> bool:
    """Whether two tables differ, counting repeated rows."""
    return bool(staleness(current, fresh, sorted(fresh.columns)).first()["stale"])


def require(found: DataFrame, what: str) -> None:
    """Stop if an audit has found anything."""
    if rows := found.limit(5).collect():
        raise ValueError(f"{what}: {rows}")
