"""The catalogue: its text grammar parsed into tables.

Order means something in a catalogue (candidates come in it), so every table carries ordinals.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..functions.variants import SPACE, name_variants, stripped, subcategory_of
from .files import shared_path

if TYPE_CHECKING:
    from ..operators.near import NearIndex

# The grammar's marks.
MARKER = "ДЕТАЛИЗАЦИЯ"
CATEGORY = f"(?U)^#{{6,}}[{SPACE}]*(.+?)[{SPACE}]*#{{6,}}[{SPACE}]*$"
LEAF = f"(?U)^[{SPACE}]*▸[{SPACE}]*(.+?)[{SPACE}]*\\[([a-z0-9-]+)\\]"
PART = f"(?U)^[{SPACE}]*([A-Z]{{2,3}}-\\d+)[{SPACE}]+(.+?)[{SPACE}]+\\|[{SPACE}]+(.+?)[{SPACE}]+\\[side:(true|false)\\|position:(true|false)\\][{SPACE}]*$"
SYNONYMS = f"(?U)^[{SPACE}]*синонимы:[{SPACE}]*(.+)$"
#: Line ends other than a line feed.
_OTHER_END = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Lines of a split.
SPLIT = 10_000


@dataclass
class Catalogue:
    """parts(part_id, name_ru, name_az, category, subcategory, leaf_code, side_flag, position_flag, part_ord),
    leaves(leaf_code, category, subcategory, leaf_ord), members(leaf_code, part_id, pos),
    names(key, part_id, key_ord, ref_ord), synonyms(key, leaf_code, key_ord, ref_ord), rejects(file, line_no, line).

    Ordinals are whole numbers that follow the order of lines; only their order matters.
    """

    parts: DataFrame
    leaves: DataFrame
    members: DataFrame
    names: DataFrame
    synonyms: DataFrame
    rejects: DataFrame | None = None
    _derived: dict = field(default_factory=dict, repr=False)

    def persist(self) -> Catalogue:
        """Keep all tables until unpersist(); nothing else here persists anything."""
        for table in self._tables().values():
            table.persist()
        self.near.persist()
        return self

    def unpersist(self) -> None:
        for table in self._tables().values():
            table.unpersist()
        self.near.unpersist()

    def _tables(self) -> dict[str, DataFrame]:
        own = {"parts": self.parts, "leaves": self.leaves, "members": self.members, "names": self.names, "synonyms": self.synonyms}
        return own | {"lookup": self.lookup, "near_refs": self.near_refs}

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write the catalogue to a folder, with all that matching derives from it and its near index (buckets: NearIndex.save)."""
        spark = self.parts.sparkSession
        tables = {**self._tables(), "sizes": spark.createDataFrame(list(self.sizes().items()), "name string, rows long").coalesce(1)}
        jobs: list[Callable] = [lambda name=name, table=table: table.write.parquet(f"{path}/{name}") for name, table in tables.items()]
        # small tables, written side by side
        with ThreadPoolExecutor(len(jobs) + 1) as pool:
            for done in [*map(pool.submit, jobs), pool.submit(self.near.save, f"{path}/near", buckets)]:
                done.result()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalogue:
        """A catalogue that save() has written. (Rejected lines are not kept.)"""
        from ..operators.near import NearIndex

        own = ("parts", "leaves", "members", "names", "synonyms")
        found = cls(*[spark.read.parquet(f"{path}/{name}") for name in own])
        found._derived = {name: spark.read.parquet(f"{path}/{name}") for name in ("lookup", "near_refs")}
        found._derived |= {"near": NearIndex.load(spark, f"{path}/near"), "sizes": dict(map(tuple, spark.read.parquet(f"{path}/sizes").collect()))}
        return found

    def _once(self, name: str, make: Callable):
        if name not in self._derived:
            self._derived[name] = make()
        return self._derived[name]

    @property
    def lookup(self) -> DataFrame:
        """key, tier (1: a name, 2: a synonym), part_id, at: the parts of every key that is looked up as it is.

        A name that is a synonym of other leaves as well brings in their parts, behind its own. A synonym
        that is no name brings in the parts of its leaves.
        """

        def make() -> DataFrame:
            named = self.names.select("key", F.lit(1).alias("tier"), "part_id", ordinals(F.lit(0), "ref_ord", F.lit(0)))
            owners = self.names.join(self.parts.select("part_id", "leaf_code"), "part_id").select("key", "leaf_code", F.lit(True).alias("own")).distinct()
            is_name = self.names.select("key", F.lit(True).alias("named")).distinct()
            said = self.synonyms.join(is_name, "key", "left").join(owners, ["key", "leaf_code"], "left").filter("own is null").join(self.members, "leaf_code")
            tier = F.when(F.col("named").isNull(), 2).otherwise(1)
            return named.unionByName(said.select("key", tier.alias("tier"), "part_id", ordinals(F.lit(2) - tier, "ref_ord", "pos")))

        return self._once("lookup", make)

    @property
    def near_index(self) -> DataFrame:
        """key, key_ord and tier (3: a name, 4: a synonym), each once: what near matching compares with."""
        of = lambda table, tier: table.select("key", "key_ord", F.lit(tier).alias("tier"))
        return self._once("near_index", lambda: of(self.names, 3).unionByName(of(self.synonyms, 4)).distinct())

    @property
    def near(self) -> NearIndex:
        """The keys of near_index with their pieces."""
        from ..operators.near import NearIndex

        return self._once("near", lambda: NearIndex(self.near_index))

    @property
    def near_refs(self) -> DataFrame:
        """found (a key), tier, part_id, ref_ord, pos: the parts that a near key stands for."""

        def make() -> DataFrame:
            names = self.names.select(F.col("key").alias("found"), F.lit(3).alias("tier"), "part_id", "ref_ord", F.lit(0).cast("long").alias("pos"))
            leaves = self.synonyms.join(self.members, "leaf_code").select(F.col("key").alias("found"), F.lit(4).alias("tier"), "part_id", "ref_ord", F.col("pos").cast("long"))
            return names.unionByName(leaves)

        return self._once("near_refs", make)

    def sizes(self) -> dict[str, int]:
        """Rows of the tables that are joined to phrases; one job, run once for a catalogue."""

        def make() -> dict:
            tables = {"parts": self.parts, "lookup": self.lookup, "near_refs": self.near_refs}
            rows = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
            return dict(map(tuple, reduce(DataFrame.union, rows).collect()))

        return self._once("sizes", make)

    def counts(self) -> DataFrame:
        """One row: n_parts, n_leaves, n_categories."""
        parts = self.parts.agg(F.count(F.lit(1)).alias("n_parts"))
        leaves = self.leaves.agg(F.count(F.lit(1)).alias("n_leaves"), F.count_distinct("category").alias("n_categories"))
        return parts.join(leaves)


def ordinals(*parts: Column | str) -> Column:
    """The place of a candidate among the others of its key."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array(*[c.cast("long") for c in columns]).alias("at")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no and line of catalogue files, line ends as in the grammar; files are numbered by their paths.

    Files are read in splits. Lines are counted split by split, and a split's first line has the number of all before it.
    """
    text = spark.read.text(path, lineSep="\n")
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    # a carriage return before the line feed belongs to it; other line ends may be within
    lines = rows.select("path", "block", "row", F.posexplode(F.split(F.regexp_replace("value", "\\r\\z", ""), _OTHER_END, -1)).alias("nth", "line"))
    split = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = split.select("path", "block", F.coalesce(before, F.lit(0)).alias("base"))
    files = split.select("path").distinct().select("path", (F.rank().over(Window.orderBy("path")) - 1).cast("long").alias("file"))  # a row a file
    order = Window.partitionBy("path", "block").orderBy("row", "nth")
    numbered = lines.withColumn("at", F.row_number().over(order)).join(base, ["path", "block"]).join(F.broadcast(files), "path")
    return numbered.select("file", (F.col("base") + F.col("at") - 1).alias("line_no"), "line")


def text_lines(texts: DataFrame) -> DataFrame:
    """file, line_no and line of a table of catalogue texts (file: a number, value)."""
    return texts.select(F.col("file").cast("long").alias("file"), F.posexplode(F.split("value", f"\r\n|\n|{_OTHER_END}", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def classified(lines: DataFrame, split: int = SPLIT) -> DataFrame:
    """Lines of the detail sections with place, kind, category and leaf_code, filled down from the headings.

    lines has line_no and line, and may have file, a number: each file has its own section and headings. A
    category heading leaves no current leaf; a leaf heading keeps the category. place orders all lines: file, then line_no.

    Headings are carried in two passes: of each split of so many lines, the last ones are gathered, and a scan over the
    splits of a file gives every split those that are in force where it begins. So a file's lines are never in one
    task, only a row for each of its splits.
    """
    line = F.col("line")
    file = F.col("file").cast("long") if "file" in lines.columns else F.lit(0).cast("long")
    rows = lines.select(file.alias("file"), F.col("line_no").cast("long").alias("line_no"), "line").withColumn("marker", F.contains(line, F.lit(MARKER)))
    gates = rows.filter("marker").groupBy("file").agg(F.min("line_no").alias("gate"))
    inside = rows.join(gates, "file").filter("line_no > gate and not marker")
    kind = F.when(line.rlike(CATEGORY), "category").when(line.rlike(LEAF), "leaf").when(line.rlike(PART), "part").when(line.rlike(SYNONYMS), "synonyms")
    heading = F.when(F.col("kind") == "category", stripped(F.replace(F.regexp_extract("line", CATEGORY, 1), F.lit("🆕"))))
    code = F.when(F.col("kind") == "leaf", F.regexp_extract("line", LEAF, 2))
    event = F.when(F.col("kind").isin("category", "leaf"), F.struct(code.alias("leaf_code")))
    known = inside.select("file", "line_no", "line", kind.alias("kind")).withColumns({"split": F.floor(F.col("line_no") / split), "heading": heading, "event": event})

    ends = known.groupBy("file", "split").agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("line_no"))).alias("heading"), F.max_by("event", F.when(F.col("event").isNotNull(), F.col("line_no"))).alias("event"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "split", F.last("heading", ignorenulls=True).over(before).alias("old_heading"), F.last("event", ignorenulls=True).over(before).alias("old_event"))
    so_far = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    category = F.coalesce(F.last("heading", ignorenulls=True).over(so_far), "old_heading", F.lit(""))
    leaf = F.coalesce(F.last("event", ignorenulls=True).over(so_far), "old_event")["leaf_code"]
    place = F.shiftleft("file", 32) + F.col("line_no")
    return known.join(carried, ["file", "split"]).select("file", "line_no", place.alias("place"), "line", "kind", category.alias("category"), leaf.alias("leaf_code"))


def parse(lines: DataFrame, split: int = SPLIT) -> Catalogue:
    """The tables of a catalogue's lines (line_no, line, and file where there are several).

    A leaf code that comes again keeps its first category and name; a part id that comes again keeps its
    last definition, and the names of both. Parts and synonyms without a current leaf are left out, and so
    is every line that the grammar does not know (those in a section are in rejects). The lines with what is
    in force at each are written to the shared folder once; all tables are read off them.
    """
    spark, path = lines.sparkSession, shared_path(lines.sparkSession, "lines")
    told = classified(lines, split)
    told.write.parquet(path)
    return tables_of(spark.read.schema(told.schema).parquet(path))


def tables_of(known: DataFrame) -> Catalogue:
    """The tables of classified lines."""
    leaf = known.filter("kind = 'leaf'").select("leaf_code", "place", "category", subcategory_of(F.regexp_extract("line", LEAF, 1)).alias("subcategory"))
    leaves = leaf.groupBy("leaf_code").agg(F.min(F.struct("place", "category", "subcategory")).alias("first")).select("leaf_code", "first.category", "first.subcategory", F.col("first.place").alias("leaf_ord"))

    rows = part_lines(known)
    fields = ["place", "leaf_code", "name_ru", "name_az", "side_flag", "position_flag"]
    last = rows.groupBy("part_id").agg(F.max(F.struct(*fields)).alias("last"), F.min("place").alias("part_ord"))
    parts = last.select("part_id", *[f"last.{c}" for c in fields[1:]], "part_ord").join(leaves.drop("leaf_ord"), "leaf_code")
    parts = parts.select("part_id", "name_ru", "name_az", "category", "subcategory", "leaf_code", "side_flag", "position_flag", "part_ord")
    members = rows.select("leaf_code", "part_id", F.col("place").alias("pos"))

    rejects = known.filter("kind is null and line rlike '\\\\S' or kind in ('part', 'synonyms') and leaf_code is null").select("file", "line_no", "line")
    return Catalogue(parts, leaves, members, indexed(name_keys(known)).withColumnRenamed("ref", "part_id"), indexed(synonym_keys(known)).withColumnRenamed("ref", "leaf_code"), rejects)


def part_lines(known: DataFrame) -> DataFrame:
    """The parts of classified lines, each line by itself."""
    group = {"id": 1, "ru": 2, "az": 3, "side": 4, "pos": 5}
    got = {k: F.regexp_extract("line", PART, n) for k, n in group.items()}
    return known.filter("kind = 'part' and leaf_code is not null").select(
        "file", "place", "leaf_code", got["id"].alias("part_id"), stripped(got["ru"]).alias("name_ru"), stripped(got["az"]).alias("name_az"),
        (got["side"] == "true").alias("side_flag"), (got["pos"] == "true").alias("position_flag"),
    )


def name_keys(known: DataFrame) -> DataFrame:
    """file, key, ref (a part) and at of every name of classified lines."""
    both = part_lines(known).select("file", "place", "part_id", F.posexplode(F.array("name_ru", "name_az")).alias("which", "name"))
    keys = both.select("file", "part_id", "place", "which", F.posexplode(name_variants(F.col("name"))).alias("nth", "variant"))
    # the place, one bit for the language, and the number of the variant
    at = F.shiftleft("place", 15) + F.shiftleft(F.col("which").cast("long"), 14) + F.col("nth")
    return keys.select("file", match_key(F.col("variant")).alias("key"), F.col("part_id").alias("ref"), at.alias("at")).filter("key <> ''")


def synonym_keys(known: DataFrame) -> DataFrame:
    """file, key, ref (a leaf) and at of every synonym of classified lines."""
    said = known.filter("kind = 'synonyms' and leaf_code is not null").select("file", "place", "leaf_code", F.posexplode(F.split(F.regexp_extract("line", SYNONYMS, 1), ",")).alias("nth", "synonym"))
    return said.select("file", match_key(F.col("synonym")).alias("key"), F.col("leaf_code").alias("ref"), (F.shiftleft("place", 15) + F.col("nth")).alias("at")).filter("key <> ''")


def indexed(rows: DataFrame) -> DataFrame:
    """key, ref, key_ord, ref_ord: each pair once, and where keys, and refs under a key, first came."""
    pairs = rows.groupBy("key", "ref").agg(F.min("at").alias("ref_ord"))
    keys = rows.groupBy("key").agg(F.min("at").alias("key_ord"))
    return pairs.join(keys, "key").select("key", "ref", "key_ord", "ref_ord")


def parse_file(spark: SparkSession, path: str | list[str]) -> Catalogue:
    """The catalogue of one file, or of several in the order of their paths."""
    return parse(read_lines(spark, path))


def parse_text(spark: SparkSession, text: str) -> Catalogue:
    return parse_texts(spark.createDataFrame([(0, text)], "file long, value string"))


def parse_texts(texts: DataFrame) -> Catalogue:
    """The catalogue of a table of texts (file, a number that orders them, and value)."""
    return parse(text_lines(texts))
