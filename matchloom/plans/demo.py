"""A catalogue over the part table: 64 names of an adjective and a noun, in leaves by noun.

A noun is its leaf's synonym, "old" is one of bolts and of rings, and "steel widget" is both a name
and a synonym of another leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..sources.catalogue import MARKER, Catalogue
from ..sources.files import shared_path

HEAVY = ("anvil", "plate", "gear")
SMALL = ("bolt", "ring")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The catalogue over a folder's part table, written to the shared folder once for a session and read from there."""
    held = spark.__dict__.setdefault("_matchloom_catalogues", {})
    if sf_dir not in held:
        path = shared_path(spark, "catalogue")
        derived(spark, sf_dir).save(path)
        held[sf_dir] = Catalogue.load(spark, path)
    return held[sf_dir]


def derived(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The names come from one distinct over the part table; all else follows from these few rows."""
    names = table(spark, sf_dir, "part").select("p_name").filter("p_name is not null").distinct()
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    category = F.when(noun.isin(*HEAVY), "heavy").when(noun.isin(*SMALL), "small").otherwise("other")
    order = F.row_number().over(Window.orderBy("p_name"))
    parts = names.select(
        F.col("p_name").alias("part_id"), F.concat(F.lit("RU "), "p_name").alias("name_ru"), F.col("p_name").alias("name_az"),
        category.alias("category"), F.initcap(noun).alias("subcategory"), noun.alias("leaf_code"),
        noun.isin(*HEAVY, "bolt").alias("side_flag"), noun.isin("gear", "ring").alias("position_flag"), order.alias("part_ord"),
    )
    leaves = parts.groupBy("leaf_code", "category", "subcategory").agg(F.min("part_ord").alias("leaf_ord"))
    members = parts.select("leaf_code", "part_id", F.col("part_ord").alias("pos"))
    keys = parts.select(match_key(F.col("name_az")).alias("key"), "part_id", F.col("part_ord").alias("key_ord"), F.lit(1).alias("ref_ord"))
    own = parts.groupBy("leaf_code").agg(F.min("part_ord").alias("ref_ord")).select(F.col("leaf_code").alias("key"), "leaf_code", F.col("ref_ord").alias("key_ord"), "ref_ord")
    more = leaves.select("leaf_code", "leaf_ord").join(spark.createDataFrame([("old", "bolt"), ("old", "ring"), ("steel widget", "gear"), ("red bolt", "anvil")], "key string, leaf_code string"), "leaf_code")
    more = more.select("key", "leaf_code", F.when(F.col("key") == "old", 1000).when(F.col("key") == "steel widget", 1001).otherwise(1002).alias("key_ord"), F.col("leaf_ord").alias("ref_ord"))
    return Catalogue(parts, leaves, members, keys, own.unionByName(more))


#: The same tables in DuckDB.
CATALOGUE_SQL = """
parts AS (SELECT p_name AS part_id, 'RU ' || p_name AS name_ru, p_name AS name_az, split_part(p_name, ' ', 2) AS leaf_code,
                 CASE WHEN split_part(p_name, ' ', 2) IN ('anvil', 'plate', 'gear') THEN 'heavy' WHEN split_part(p_name, ' ', 2) IN ('bolt', 'ring') THEN 'small' ELSE 'other' END AS category,
                 split_part(p_name, ' ', 2) IN ('anvil', 'plate', 'gear', 'bolt') AS side_flag, split_part(p_name, ' ', 2) IN ('gear', 'ring') AS position_flag,
                 row_number() OVER (ORDER BY p_name) AS part_ord
          FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)),
leaves AS (SELECT leaf_code, category, min(part_ord) AS leaf_ord FROM parts GROUP BY ALL),
names AS (SELECT name_az AS key, part_id, part_ord AS key_ord FROM parts),
synonyms AS (SELECT leaf_code AS key, leaf_code, leaf_ord AS key_ord FROM leaves
             UNION ALL SELECT x.key, leaf_code, x.o FROM leaves JOIN (VALUES ('old', 'bolt', 1000), ('old', 'ring', 1000), ('steel widget', 'gear', 1001), ('red bolt', 'anvil', 1002)) x(key, leaf_code, o) USING (leaf_code)),
index AS (SELECT key, category FROM names JOIN parts USING (part_id) UNION SELECT key, category FROM synonyms JOIN leaves USING (leaf_code))"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, phrase, raw_text, threshold, restrict_category: a phrase for every row of part."""
    parts = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(10))
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    phrase = (
        F.when(kind == 0, F.concat(F.lit("("), "p_name", F.lit(").")))
        .when(kind == 1, noun)
        .when(kind == 2, F.col("p_name").substr(F.lit(1), F.length("p_name") - 1))
        .when(kind == 3, F.concat(F.lit("b"), "p_name"))
        .when(kind == 4, F.concat(noun, F.lit("s")))
        .when(kind == 5, F.lit("old"))
        .when(kind == 6, F.concat(F.lit("no such "), "p_brand"))
        .when(kind == 7, F.lit("steel widget"))
        .otherwise(F.col("p_name"))
    )
    raw = F.when(kind == 0, F.lit("sol arxa")).when(kind == 8, F.lit("Right, front")).when(kind == 9, F.lit("on"))
    threshold = F.when(F.pmod("p_partkey", F.lit(4)) == 0, 0.75).when(F.pmod("p_partkey", F.lit(4)) == 1, 1.0).otherwise(0.9)
    restrict = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit("heavy"))
    return parts.select(F.col("p_partkey").alias("qid"), phrase.alias("phrase"), raw.alias("raw_text"), threshold.alias("threshold"), restrict.alias("restrict_category"))


KEYED_SQL = """
keyed AS (SELECT *, array_to_string(regexp_extract_all(lower(translate(phrase, 'İIƏÇŞĞÖÜ', 'iıəçşğöü')), '[0-9a-zçğıəöüşЀ-ӿ]+'), ' ') AS key FROM phrases)"""

PHRASES_SQL = """
phrases AS (SELECT p_partkey AS qid,
  CASE p_partkey % 10 WHEN 0 THEN '(' || p_name || ').' WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN left(p_name, length(p_name) - 1) WHEN 3 THEN 'b' || p_name
       WHEN 4 THEN split_part(p_name, ' ', 2) || 's' WHEN 5 THEN 'old' WHEN 6 THEN 'no such ' || p_brand WHEN 7 THEN 'steel widget' ELSE p_name END AS phrase,
  CASE p_partkey % 10 WHEN 0 THEN 'sol arxa' WHEN 8 THEN 'Right, front' WHEN 9 THEN 'on' END AS raw_text,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS threshold,
  CASE WHEN p_partkey % 3 = 0 THEN 'heavy' END AS restrict_category FROM part),
""" + KEYED_SQL


def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no and line of a catalogue text over the part table: a leaf for each noun, its synonyms last."""
    names = table(spark, sf_dir, "part").select("p_name").filter("p_name is not null").distinct()
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    category = F.when(noun.isin(*HEAVY), "heavy").when(noun.isin(*SMALL), "small").otherwise("other")
    rows = names.select("p_name", noun.alias("noun"), category.alias("category"))
    rows = rows.withColumn("k", F.row_number().over(Window.orderBy("category", "noun", "p_name")))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("k")) == 1
    last = F.row_number().over(Window.partitionBy("noun").orderBy(F.desc("k"))) == 1
    code = F.concat(F.lit("PA-"), F.lpad(F.col("k").cast("string"), 5, "0"))
    part = F.concat(F.lit("  "), code, F.lit("  RU "), "p_name", F.lit(" | "), "p_name", F.lit("  [side:"), F.col("noun").isin(*HEAVY).cast("string"), F.lit("|position:"), F.col("noun").isin("gear", "ring").cast("string"), F.lit("]"))
    lines = F.array(
        F.when(F.col("k") == 1, F.lit("ДЕТАЛИЗАЦИЯ")),
        F.when(first("category"), F.concat(F.lit("###### "), "category", F.lit(" ######"))),
        F.when(first("noun"), F.concat(F.lit("▸ "), F.initcap("noun"), F.lit(" / Деталь ["), "noun", F.lit("]"))),
        part,
        F.when(last, F.concat(F.lit("  синонимы: "), "noun", F.lit(", a "), "noun")),
    )
    every = rows.select("k", lines.alias("lines")).select("k", F.posexplode("lines").alias("at", "line")).filter("line is not null")
    return every.select((F.row_number().over(Window.orderBy("k", "at")) - 1).cast("int").alias("line_no"), "line")


#: What that text holds, in DuckDB.
LINES_SQL = """
WITH n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS noun FROM part WHERE p_name IS NOT NULL),
c AS (SELECT *, CASE WHEN noun IN ('anvil', 'plate', 'gear') THEN 'heavy' WHEN noun IN ('bolt', 'ring') THEN 'small' ELSE 'other' END AS category FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY category, noun, p_name) AS k FROM c),
file_parts AS (SELECT 'PA-' || lpad(CAST(k AS VARCHAR), 5, '0') AS part_id, 'RU ' || p_name AS name_ru, p_name AS name_az, category, upper(left(noun, 1)) || substr(noun, 2) AS subcategory, noun AS leaf_code,
                noun IN ('anvil', 'plate', 'gear') AS side_flag, noun IN ('gear', 'ring') AS position_flag, k FROM k)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and value: catalogue texts of 500 rows of part each, with all that a catalogue can have wrong.

    Ten rows make a block: a category, a leaf (codes come again), parts (ids come again), synonyms (some empty), and a
    line that means nothing. In each fourth block a second category comes before the last part and the synonyms, which
    so have no leaf. A text's first twenty lines come before its section, whose mark is the twenty-first.
    """
    k, name = F.col("p_partkey"), F.col("p_name")
    text = lambda x: x.cast("string")
    block, step, word = F.floor(k / 10), F.pmod(k, F.lit(10)), lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    category = F.concat(F.lit("###### Cat "), text(F.pmod(block, F.lit(7))), F.lit(" ######"))
    part = F.concat(F.lit("  PA-"), text(F.floor(k / 3)), F.lit("  Имя "), name, F.lit(" | "), name, F.lit(" "), text(step), F.lit("  [side:"), text(step == 3), F.lit("|position:"), text(step == 4), F.lit("]"))
    line = (
        F.when(F.pmod(k, F.lit(500)) == 20, F.lit(f"=== {MARKER} ==="))
        .when(step == 0, category)
        .when((step == 5) & (F.pmod(block, F.lit(4)) == 0), category)
        .when(step == 1, F.concat(F.lit("▸ "), name, F.lit(" / Деталь ["), word(2), F.lit("-"), text(F.pmod(block, F.lit(5))), F.lit("]")))
        .when(step == 7, F.concat(F.lit("  синонимы: "), word(2), F.lit(",, "), word(1), F.lit(" (x), ?!")))
        .when(step == 8, F.lit("  nothing here"))
        .otherwise(part)
    )
    rows = table(spark, sf_dir, "part").select(F.floor(k / 500).alias("file"), k.alias("k"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("k", "line")))
    return rows.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("value"))


#: Those lines and what is in force at each, in DuckDB.
TEXTS_SQL = """
WITH t AS (SELECT p_partkey AS k, p_partkey // 500 AS file, p_partkey // 10 AS block, p_partkey % 10 AS step, p_name, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two,
                  row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS line_no FROM part),
said AS (SELECT *, CASE WHEN step = 0 OR step = 5 AND block % 4 = 0 THEN 'category' WHEN step = 1 THEN 'leaf' WHEN step = 7 THEN 'synonyms' WHEN step <> 8 THEN 'part' END AS kind,
                   (file << 32) + line_no AS place FROM t WHERE k % 500 > 20 AND EXISTS (SELECT 1 FROM t m WHERE m.file = t.file AND m.k % 500 = 20)),
told AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'category' THEN 'Cat ' || (block % 7) END IGNORE NULLS) OVER o, '') AS category,
                nullif(last_value(CASE WHEN kind = 'category' THEN '-' WHEN kind = 'leaf' THEN two || '-' || (block % 5) END IGNORE NULLS) OVER o, '-') AS leaf_code
         FROM said WINDOW o AS (PARTITION BY file ORDER BY k ROWS UNBOUNDED PRECEDING)),
kept_leaves AS (SELECT leaf_code, arg_min(category, place) AS category, arg_min(p_name, place) AS subcategory, min(place) AS leaf_ord FROM told WHERE kind = 'leaf' GROUP BY leaf_code),
kept_parts AS (SELECT 'PA-' || (k // 3) AS part_id, 'Имя ' || p_name AS name_ru, p_name || ' ' || step AS name_az, leaf_code, step, place FROM told WHERE kind = 'part' AND leaf_code IS NOT NULL),
kept_names AS (SELECT lower(n) AS key, part_id FROM (SELECT part_id, unnest([name_ru, name_az]) AS n FROM kept_parts)),
kept_synonyms AS (SELECT key, leaf_code, (place << 15) + nth AS spot FROM (SELECT leaf_code, place, unnest([two, one || ' x']) AS key, unnest([0, 2]) AS nth FROM told WHERE kind = 'synonyms' AND leaf_code IS NOT NULL))"""
