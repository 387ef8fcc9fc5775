"""The registered queries of the engine, each with its SQL."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import FRONT, LEFT, REAR, RIGHT, passthrough, position, search_space, side
from ..functions.text import match_key, similarity, words
from ..functions.variants import name_variants, slash_expansion, subcategory_of
from ..operators import categories, funnel, matching, quality
from ..operators.near import NearIndex, near_keys
from .. import commands
from ..session import register
from ..sources.catalogue import classified, parse, parse_file, parse_texts, text_lines
from ..sources.datasource import read_catalogue, write_catalogue
from ..sources.deltas import Store
from ..sources.files import read_category_index, read_index, read_report, result_json, shared_path, write_category_index, write_results, write_text
from ..streaming import sessions
from ..streaming.phrases import match_to, read_matched
from . import reports
from .demo import CATALOGUE_SQL, KEYED_SQL, LINES_SQL, PHRASES_SQL, TEXTS_SQL, catalogue, catalogue_lines, phrases, table, texts
from .registry import ORACLES, QUERIES


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


# --- text functions -----------------------------------------------------------------------------------

_WORDS_SQL = "regexp_extract_all(text, '[0-9a-zçğıəöüşA-ZÇĞİIƏÖÜŞЀ-ӿ]+')"
_LOWER_SQL = "lower(translate({}, 'İIƏÇŞĞÖÜ', 'iıəçşğöü'))"


@query("normalize_key", f"SELECT doc_id, {_LOWER_SQL.format(f"array_to_string({_WORDS_SQL}, ' ')")} AS key FROM documents")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", match_key(F.col("text")).alias("key"))


@query("token_stream", f"SELECT {_LOWER_SQL.format('token')} AS token, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS token FROM documents) GROUP BY 1")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_PAIRS_SQL = "SELECT p_partkey, p_name AS a, p_type AS b FROM part"


@query("edit_distance", f"SELECT p_partkey, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM ({_PAIRS_SQL})")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("similarity_score", f"SELECT p_partkey, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS score FROM ({_PAIRS_SQL})")
def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", similarity(F.col("p_name"), F.col("p_type")).alias("score"))


# --- tiers --------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.with_parameters(phrases(spark, sf_dir)).withColumn("key", match_key(F.col("phrase")))
    return rows.select("key", "threshold").distinct()


_HITS_SQL = f"""WITH {CATALOGUE_SQL}, {PHRASES_SQL},
pairs AS (SELECT DISTINCT key, threshold FROM keyed),
t1 AS (SELECT key, threshold, 1 AS tier, 1.0 AS score, part_id, 0 AS a, 0 AS b, 0 AS c FROM pairs JOIN names USING (key)
       UNION ALL SELECT p.key, threshold, 1, 1.0, m.part_id, 1, s.key_ord, m.part_ord FROM pairs p JOIN synonyms s USING (key) JOIN parts m ON m.leaf_code = s.leaf_code
       WHERE p.key IN (SELECT key FROM names) AND NOT EXISTS (SELECT 1 FROM names n JOIN parts o USING (part_id) WHERE n.key = p.key AND o.leaf_code = s.leaf_code)),
t2 AS (SELECT p.key, threshold, 2 AS tier, 1.0 AS score, m.part_id, 0 AS a, l.leaf_ord AS b, m.part_ord AS c FROM pairs p JOIN synonyms s USING (key) JOIN leaves l USING (leaf_code) JOIN parts m USING (leaf_code) WHERE p.key NOT IN (SELECT key FROM names)),
rest AS (SELECT * FROM pairs WHERE key NOT IN (SELECT key FROM names) AND key NOT IN (SELECT key FROM synonyms)),
n3 AS (SELECT r.key, r.threshold, n.part_id, n.key_ord, 1.0 - CAST(levenshtein(r.key, n.key) AS DOUBLE) / greatest(length(r.key), length(n.key)) AS score FROM rest r, names n),
t3 AS (SELECT key, threshold, 3 AS tier, score, part_id, key_ord AS a, 1 AS b, 0 AS c FROM n3 WHERE score >= threshold QUALIFY rank() OVER (PARTITION BY key, threshold ORDER BY score DESC) = 1),
n4 AS (SELECT r.key, r.threshold, s.leaf_code, s.key_ord, 1.0 - CAST(levenshtein(r.key, s.key) AS DOUBLE) / greatest(length(r.key), length(s.key)) AS score FROM rest r, synonyms s
       WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.key = r.key AND t3.threshold = r.threshold)),
b4 AS (SELECT * FROM n4 WHERE score >= threshold QUALIFY rank() OVER (PARTITION BY key, threshold ORDER BY score DESC) = 1),
t4 AS (SELECT b4.key, threshold, 4 AS tier, score, m.part_id, b4.key_ord AS a, l.leaf_ord AS b, m.part_ord AS c FROM b4 JOIN leaves l USING (leaf_code) JOIN parts m USING (leaf_code)),
hits AS (SELECT key, threshold, tier, score, part_id, min((a, b, c)) AS spot FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) GROUP BY ALL)"""


def _tier(name: str, tiers: tuple[int, ...]) -> None:
    which = ", ".join(map(str, tiers))

    @query(name, f"{_HITS_SQL} SELECT key, threshold, tier, round(score, 3) AS score, count(*) AS n, string_agg(part_id, ',' ORDER BY part_id) AS ids FROM hits WHERE tier IN ({which}) GROUP BY ALL")
    def of_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matching.hits(_pairs(spark, sf_dir), catalogue(spark, sf_dir)).filter(F.col("tier").isin(*tiers))
        grouped = found.groupBy("key", "threshold", "tier", "score").agg(F.array_sort(F.collect_set("part_id")).alias("ids"))
        return grouped.select("key", "threshold", "tier", F.round("score", 3).alias("score"), F.size("ids").cast("long").alias("n"), _joined("ids").alias("ids"))


for _name, _tiers in {"exact_name_match": (1,), "exact_synonym_group": (2,), "near_name_match": (3,), "near_synonym_match": (4,)}.items():
    _tier(_name, _tiers)


@query("collision_guard", f"{_HITS_SQL} SELECT key, count(DISTINCT part_id) AS n FROM hits WHERE tier = 1 GROUP BY key HAVING count(DISTINCT part_id) > 1")
def collision_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.hits(_pairs(spark, sf_dir), catalogue(spark, sf_dir)).filter("tier = 1")
    return found.groupBy("key").agg(F.count_distinct("part_id").alias("n")).filter("n > 1")


_MATCH_SQL = f"""{_HITS_SQL},
cand AS (SELECT k.qid, k.phrase, k.raw_text, h.tier, h.score, h.spot, m.* FROM keyed k JOIN hits h USING (key, threshold) JOIN parts m USING (part_id) WHERE {{keep}}),
per AS (SELECT qid, any_value(phrase) AS phrase, any_value(raw_text) AS raw_text, any_value(tier) AS tier, round(any_value(score), 3) AS score, count(*) AS n, string_agg(part_id, ',' ORDER BY spot, part_id) AS ids,
               any_value(part_id) AS part_id, any_value(side_flag) AS side_flag, any_value(position_flag) AS position_flag FROM cand GROUP BY qid),
said AS (SELECT *, regexp_extract_all(lower(translate(phrase || ' ' || coalesce(raw_text, ''), 'İIƏÇŞĞÖÜ', 'iıəçşğöü')), '[0-9a-zçğıəöüşЀ-ӿ]+') AS w FROM per),
att AS (SELECT *, CASE WHEN n = 1 AND side_flag THEN CASE WHEN list_has_any(w, ['sol']) AND list_has_any(w, ['right']) THEN 'sol,sağ' WHEN list_has_any(w, ['sol']) THEN 'sol' WHEN list_has_any(w, ['right']) THEN 'sağ' END END AS side,
               CASE WHEN n = 1 AND position_flag THEN CASE WHEN list_has_any(w, ['front']) AND list_has_any(w, ['arxa']) THEN 'ön,arxa' WHEN list_has_any(w, ['front']) THEN 'ön' WHEN list_has_any(w, ['arxa']) THEN 'arxa' END END AS position FROM said),
res AS (SELECT k.qid, CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'single_match' ELSE 'ambiguous' END AS status, coalesce(ids, '') AS ids, score AS match_score, tier, side, position,
               concat_ws(',', CASE WHEN n = 1 AND side_flag AND side IS NULL THEN 'side' END, CASE WHEN n = 1 AND position_flag AND position IS NULL THEN 'position' END) AS needs
        FROM keyed k LEFT JOIN att USING (qid))"""
_ALL_SQL = _MATCH_SQL.format(keep="TRUE")
_KEPT_SQL = _MATCH_SQL.format(keep="k.restrict_category IS NULL OR m.category = k.restrict_category")


def _matched(spark: SparkSession, sf_dir: str, restricted: bool = False) -> DataFrame:
    rows = phrases(spark, sf_dir)
    return _flat(matching.match(rows if restricted else rows.drop("restrict_category"), catalogue(spark, sf_dir)))


def _flat(found: DataFrame) -> DataFrame:
    ids = F.when(F.col("result.status") == "single_match", F.col("result.part_id")).otherwise(_joined("result.candidates.part_id"))
    return found.select(
        "qid", "result.status", ids.alias("ids"), F.round("result.match_score", 3).alias("match_score"), "tier",
        "result.attributes.side", "result.attributes.position", _joined("result.needs_clarification").alias("needs"), "threshold",
    )


_RESULT = "qid, status, ids, match_score, tier, side, position, needs"


@query("tiered_match", f"{_ALL_SQL} SELECT {_RESULT} FROM res")
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).drop("threshold")


@query("restricted_match", f"{_KEPT_SQL} SELECT {_RESULT} FROM res")
def restricted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, True).drop("threshold")


@query("match_status_counts", f"{_ALL_SQL} SELECT status, tier, count(*) AS n FROM res GROUP BY ALL")
def match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).groupBy("status", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("threshold_exact_only", f"{_ALL_SQL} SELECT qid, status, tier FROM res JOIN keyed USING (qid) WHERE threshold = 1.0")
def threshold_exact_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).filter("threshold = 1.0").select("qid", "status", "tier")


@query("no_match_rows", f"{_ALL_SQL} SELECT qid FROM res WHERE status = 'no_match'")
def no_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).filter("status = 'no_match'").select("qid")


@query("needs_clarification", f"{_KEPT_SQL} SELECT needs, count(*) AS n FROM res GROUP BY needs")
def needs_clarification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, True).groupBy("needs").agg(F.count(F.lit(1)).alias("n"))


_LOW = "CASE p_partkey % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 ELSE 0.9 END", "CASE p_partkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.0 ELSE -1.0 END"


@query("low_threshold_match", f"{_ALL_SQL.replace(*_LOW)} SELECT {_RESULT} FROM res")
def low_threshold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("qid", F.lit(3))
    rows = phrases(spark, sf_dir).drop("restrict_category").withColumn("threshold", F.when(kind == 0, 0.3).when(kind == 1, 0.0).otherwise(-1.0))
    return _flat(matching.match(rows, catalogue(spark, sf_dir))).drop("threshold")


_NAMES_SQL = """named AS (SELECT DISTINCT lower(p_name || ' ' || p_brand || ' ' || p_partkey) AS name, p_partkey AS id FROM part UNION SELECT lower(s_name || ' ' || s_suppkey), s_suppkey FROM supplier
UNION SELECT lower(c_name || ' ' || c_mktsegment), c_custkey FROM customer), keys AS (SELECT DISTINCT name AS found FROM named), asked AS (SELECT DISTINCT substr(name, 2) || 'x' AS key FROM named WHERE id % 50 = 0)"""


@query(
    "near_index_match",
    f"""WITH {_NAMES_SQL} SELECT key, found, round(score, 6) AS score FROM (SELECT key, found, 1.0::DOUBLE - CAST(levenshtein(key, found) AS DOUBLE) / greatest(length(key), length(found)) AS score FROM asked, keys)
WHERE score >= 0.85 QUALIFY rank() OVER (PARTITION BY key ORDER BY score DESC) = 1""",
)
def near_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with two edits against the names of three tables, by an index that is written and read again."""
    part, supplier, customer = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    named = part.select(F.concat_ws(" ", "p_name", "p_brand", "p_partkey").alias("name"), F.col("p_partkey").alias("id"))
    named = named.unionByName(supplier.select(F.concat_ws(" ", "s_name", "s_suppkey").alias("name"), F.col("s_suppkey").alias("id"))).unionByName(customer.select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), F.col("c_custkey").alias("id")))
    named, path = named.withColumn("name", F.lower("name")).distinct(), shared_path(spark, "near")
    NearIndex(named.select(F.col("name").alias("key"), F.lit(0).alias("key_ord"), F.lit(3).alias("tier")).distinct()).save(path, 8)
    asked = named.filter("id % 50 = 0").select(F.concat(F.expr("substring(name, 2)"), F.lit("x")).alias("key"), F.lit(0.85).alias("threshold")).distinct()
    return near_keys(asked, NearIndex.load(spark, path)).select("key", "found", F.round("score", 6).alias("score"))


# --- attributes ---------------------------------------------------------------------------------------

_SAID = {0: "sol ön", 1: "SAĞ tərəf, left", 2: "on ədəd", 3: "RIGHT", 4: "слева сзади", 5: ""}
_TEXT_SQL = "SELECT o_orderkey, o_orderstatus || ' ' || CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SAID.items()) + " END AS text FROM orders"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID.values())), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", search_space(F.col("o_orderstatus"), said).alias("text"))


_SPLIT_SQL = "regexp_extract_all(lower(translate(text, 'İIƏÇŞĞÖÜ', 'iıəçşğöü')), '[0-9a-zçğıəöüşЀ-ӿ]+')"


@query("attributes_side", f"SELECT o_orderkey, CASE WHEN list_has_any(w, ['sol', 'left', 'слева']) AND list_has_any(w, ['sağ', 'right']) THEN 'sol,sağ' WHEN list_has_any(w, ['sol', 'left', 'слева']) THEN 'sol' WHEN list_has_any(w, ['sağ', 'right']) THEN 'sağ' END AS side FROM (SELECT o_orderkey, {_SPLIT_SQL} AS w FROM ({_TEXT_SQL}))")
def attributes_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("o_orderkey", side(F.col("text")).alias("side"))


@query("attributes_position", f"SELECT o_orderkey, CASE WHEN list_has_any(w, ['ön']) THEN 'ön' WHEN list_has_any(w, ['сзади']) THEN 'arxa' END AS position FROM (SELECT o_orderkey, {_SPLIT_SQL} AS w FROM ({_TEXT_SQL}))")
def attributes_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("o_orderkey", position(F.col("text")).alias("position"))


# every direction word, with another one
_WORDS = [*LEFT, *RIGHT, *FRONT, *REAR]
_PLACES_SQL = f"SELECT o_orderkey, {_WORDS}[o_orderkey % {len(_WORDS)} + 1] || ', ' || {_WORDS}[o_orderkey * 5 // 3 % {len(_WORDS)} + 1] AS text FROM orders"


def _direction_sql(first: list[str], one: str, second: list[str], two: str) -> str:
    return f"CASE WHEN list_has_any(w, {first}) AND list_has_any(w, {second}) THEN '{one},{two}' WHEN list_has_any(w, {first}) THEN '{one}' WHEN list_has_any(w, {second}) THEN '{two}' END"


@query("attributes_every_word", f"SELECT o_orderkey, {_direction_sql(LEFT, 'sol', RIGHT, 'sağ')} AS side, {_direction_sql(FRONT, 'ön', REAR, 'arxa')} AS position FROM (SELECT o_orderkey, string_split(text, ', ') AS w FROM ({_PLACES_SQL}))")
def attributes_every_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, _WORDS))
    word = lambda k: F.get(said, F.pmod(k, F.lit(len(_WORDS))).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(word(F.col("o_orderkey")), F.lit(", "), word(F.floor(F.col("o_orderkey") * 5 / 3))).alias("text"))
    return rows.select("o_orderkey", side(F.col("text")).alias("side"), position(F.col("text")).alias("position"))


@query("passthrough", "SELECT p_partkey, coalesce(nullif(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END, ''), p_name) AS forwarded FROM part")
def passthrough_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "").when(F.pmod("p_partkey", F.lit(3)) == 1, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", passthrough(F.col("p_name"), raw).alias("forwarded"))


# --- names and catalogue text -------------------------------------------------------------------------


@query("name_variants", "SELECT DISTINCT p_name || ' (' || p_brand || ' / x)' AS name, v AS variant FROM part, (SELECT unnest([0, 1, 2, 3]) AS k), LATERAL (SELECT CASE k WHEN 0 THEN p_name || ' (' || p_brand || ' / x)' WHEN 1 THEN p_brand || ' / x' WHEN 2 THEN p_brand ELSE 'x' END AS v)")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" / x)"))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.explode(name_variants(F.col("name"))).alias("variant"))


@query("slash_expansion", "SELECT DISTINCT split_part(p_name, ' ', 1) || '/' || p_brand || ' ' || split_part(p_name, ' ', 2) AS name, unnest([split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2), p_brand || ' ' || split_part(p_name, ' ', 2)]) AS variant FROM part")
def expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2)]
    name = F.concat(part[0], F.lit("/"), "p_brand", F.lit(" "), part[1])
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.explode(slash_expansion(F.col("name"))).alias("variant"))


_ALTERNATIVES = [str(n) for n in range(1, 17)]
_SHAPES_SQL = f"""WITH t AS (SELECT DISTINCT p_partkey % 6 AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_brand AS g FROM part),
n AS (SELECT *, CASE s WHEN 0 THEN a || '/x ' || b || '/y q/z r/w' WHEN 1 THEN a || '/{'/'.join(_ALTERNATIVES)} ' || b WHEN 2 THEN a || '/{'/'.join(_ALTERNATIVES[:15])} ' || b
                       WHEN 3 THEN a || ' (' || g || '/' || b || ' x)' WHEN 4 THEN a || '/' || g || ' ' || b || ' (x)' ELSE a || ' (' || b || ') (' || g || ')' END AS name FROM t),
v AS (SELECT name, name AS variant FROM n
      UNION ALL SELECT name, p || ' ' || q || ' ' || x || ' ' || y FROM n, LATERAL (SELECT unnest([a, 'x']) AS p), LATERAL (SELECT unnest([b, 'y']) AS q), (SELECT unnest(['q', 'z']) AS x), (SELECT unnest(['r', 'w']) AS y) WHERE s = 0
      UNION ALL SELECT name, unnest(list_prepend(a, {_ALTERNATIVES[:15]})) || ' ' || b FROM n WHERE s = 2
      UNION ALL SELECT name, unnest([g || '/' || b || ' x', g, b || ' x']) FROM n WHERE s = 3 UNION ALL SELECT name, unnest(['x', a || ' ' || b, g || ' ' || b]) FROM n WHERE s = 4 UNION ALL SELECT name, unnest([b, g]) FROM n WHERE s = 5)"""


# 16 combinations are expanded and 17 are not; slashes within brackets, beside them, and several brackets
@query("name_shapes", f"{_SHAPES_SQL} SELECT DISTINCT name, variant FROM v")
def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, g = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_brand")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [text(a, "/x ", b, "/y q/z r/w"), text(a, "/" + "/".join(_ALTERNATIVES) + " ", b), text(a, "/" + "/".join(_ALTERNATIVES[:15]) + " ", b), text(a, " (", g, "/", b, " x)"), text(a, "/", g, " ", b, " (x)"), text(a, " (", b, ") (", g, ")")]
    name = F.get(F.array(*shapes), F.pmod("p_partkey", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.explode(name_variants(F.col("name"))).alias("variant"))


# the new mark; Cyrillic in the middle stays, and so does a first segment; a slash without spaces separates nothing
@query(
    "subcategory_shapes",
    """SELECT DISTINCT unnest(['🆕 ' || p_name || ' / деталь', p_name || ' / деталь / ' || p_brand, 'деталь / запчасть / ' || p_name || ' часть', p_name || '/' || p_brand || ' / x / ы 🆕', p_name]) AS leaf,
       unnest([p_name, p_name || ' / деталь / ' || p_brand, 'деталь', p_name || '/' || p_brand || ' / x', p_name]) AS subcategory FROM part""",
)
def subcategory_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    shapes = [F.concat(F.lit("🆕 "), name, F.lit(" / деталь")), F.concat(name, F.lit(" / деталь / "), brand), F.concat(F.lit("деталь / запчасть / "), name, F.lit(" часть")), F.concat(name, F.lit("/"), brand, F.lit(" / x / ы 🆕")), name]
    return table(spark, sf_dir, "part").select(F.explode(F.array(*shapes)).alias("leaf")).distinct().select("leaf", subcategory_of(F.col("leaf")).alias("subcategory"))


@query("subcategory_of", "SELECT DISTINCT p_name || ' / ' || p_brand || ' / деталь' AS leaf, p_name || ' / ' || p_brand AS subcategory FROM part")
def subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" / деталь"))
    return table(spark, sf_dir, "part").select(leaf.alias("leaf")).distinct().select("leaf", subcategory_of(F.col("leaf")).alias("subcategory"))


@query(
    "catalogue_parse",
    f"""{TEXTS_SQL} SELECT part_id, arg_max(name_ru, place) AS name_ru, arg_max(name_az, place) AS name_az, any_value(l.category) AS category, any_value(l.subcategory) AS subcategory, any_value(l.leaf_code) AS leaf_code,
       arg_max(step = 3, place) AS side_flag, arg_max(step = 4, place) AS position_flag, min(place) AS part_ord
FROM (SELECT *, last_value(leaf_code) OVER (PARTITION BY part_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own FROM kept_parts) p JOIN kept_leaves l ON l.leaf_code = p.own GROUP BY part_id""",
)
def catalogue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_texts(texts(spark, sf_dir)).parts


def _file_catalogue(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "catalogue")
    write_text(catalogue_lines(spark, sf_dir), path)
    return path


@query("catalogue_file", f"{LINES_SQL} SELECT part_id, name_ru, name_az, category, subcategory, leaf_code, side_flag, position_flag FROM file_parts")
def catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_file(spark, _file_catalogue(spark, sf_dir)).parts.drop("part_ord")


@query("catalogue_source", f"{LINES_SQL} SELECT part_id, name_ru, name_az, category, subcategory, leaf_code, side_flag, position_flag FROM file_parts")
def catalogue_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "source")
    write_catalogue(catalogue_lines(spark, sf_dir), path, 3)
    return parse(read_catalogue(spark, path, 2000)).parts.drop("part_ord")


@query("catalogue_file_keys", f"{LINES_SQL} SELECT key, ref, kind FROM (SELECT p_name AS key, 'PA-' || lpad(CAST(k AS VARCHAR), 5, '0') AS ref, 'name' AS kind FROM k UNION ALL SELECT 'ru ' || p_name, 'PA-' || lpad(CAST(k AS VARCHAR), 5, '0'), 'name' FROM k UNION ALL SELECT DISTINCT noun, noun, 'synonym' FROM k UNION ALL SELECT DISTINCT 'a ' || noun, noun, 'synonym' FROM k)")
def catalogue_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_file(spark, _file_catalogue(spark, sf_dir))
    names = found.names.select("key", F.col("part_id").alias("ref"), F.lit("name").alias("kind"))
    return names.unionByName(found.synonyms.select("key", F.col("leaf_code").alias("ref"), F.lit("synonym").alias("kind")))


@query("cli_match", f"{LINES_SQL}, asked AS (SELECT min(p_name) AS phrase FROM k UNION ALL SELECT max(p_name) FROM k) SELECT phrase, 'single_match' AS status, part_id, category, CASE WHEN side_flag THEN 'sol' END AS side FROM asked JOIN file_parts ON name_az = phrase UNION ALL SELECT 'nothing like it', 'no_match', NULL, NULL, NULL")
def cli_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file_catalogue(spark, sf_dir)
    ends = table(spark, sf_dir, "part").agg(F.min("p_name"), F.max("p_name")).first()
    rows = []
    for phrase in (*ends, "nothing like it"):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            commands.main([phrase, "--raw", "sol", "--dict", path])
        got = json.loads(said.getvalue())
        rows.append((phrase, got["status"], got["part_id"], got["category"], got["attributes"]["side"]))
    return spark.createDataFrame(rows, "phrase string, status string, part_id string, category string, side string")


@query("fill_down", f"{TEXTS_SQL} SELECT file, line_no, place, kind, category, leaf_code FROM told")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(text_lines(texts(spark, sf_dir)), 64).drop("line")


@query("leaf_first_wins", f"{TEXTS_SQL} SELECT leaf_code, category, subcategory, leaf_ord FROM kept_leaves")
def leaf_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_texts(texts(spark, sf_dir)).leaves


@query("part_last_wins", f"{TEXTS_SQL} SELECT DISTINCT key, part_id FROM kept_names")
def part_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_texts(texts(spark, sf_dir)).names.select("key", "part_id")


@query("synonym_index", f"{TEXTS_SQL} SELECT DISTINCT key, leaf_code, min(spot) OVER (PARTITION BY key) AS key_ord, min(spot) OVER (PARTITION BY key, leaf_code) AS ref_ord FROM kept_synonyms")
def synonym_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_texts(texts(spark, sf_dir)).synonyms


@query(
    "catalogue_deltas",
    f"""{TEXTS_SQL}, spots AS (SELECT lower(n) AS key, part_id, (place << 15) + (which << 14) AS spot FROM (SELECT part_id, place, unnest([name_ru, name_az]) AS n, unnest([0, 1]) AS which FROM kept_parts WHERE place >> 32 <> 1))
SELECT DISTINCT key, part_id, min(spot) OVER (PARTITION BY key) AS key_ord, min(spot) OVER (PARTITION BY key, part_id) AS ref_ord FROM spots""",
)
def catalogue_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, store = texts(spark, sf_dir), Store(spark, shared_path(spark, "store"))
    store.apply(whole.filter("file % 2 = 1").unionByName(whole.filter("file = 0").withColumn("value", F.substring("value", 1, 9000))))
    store.apply(whole.filter("file % 2 = 0"))
    store.apply(spark.range(1, 2).select(F.col("id").alias("file"), F.lit(None).cast("string").alias("value")))
    return store.catalogue().names


@query("orphan_lines", f"{TEXTS_SQL} SELECT file, line_no, kind FROM told WHERE kind IS NULL OR kind IN ('part', 'synonyms') AND leaf_code IS NULL")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.contains("line", F.lit("синонимы")), "synonyms").when(F.contains("line", F.lit("[side:")), "part")
    return parse_texts(texts(spark, sf_dir)).rejects.select("file", "line_no", kind.alias("kind"))


@query("catalogue_counts", f"WITH {CATALOGUE_SQL} SELECT (SELECT count(*) FROM parts) AS n_parts, (SELECT count(*) FROM leaves) AS n_leaves, (SELECT count(DISTINCT category) FROM leaves) AS n_categories")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).counts()


# --- categories ---------------------------------------------------------------------------------------

_INDEX_SQL = f"WITH {CATALOGUE_SQL}, words AS (SELECT key, string_agg(category, ',' ORDER BY category) AS categories, count(*) AS n FROM index GROUP BY key)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.category_index(catalogue(spark, sf_dir))


@query("category_index", f"{_INDEX_SQL} SELECT key, categories FROM words")
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.grouped_index(_index(spark, sf_dir)).select("key", _joined("categories").alias("categories"))


@query("ambiguous_words", f"{_INDEX_SQL} SELECT key, categories FROM words WHERE n > 1")
def ambiguous_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.ambiguous_words(_index(spark, sf_dir)).select("key", _joined("categories").alias("categories"))


@query("index_meta", f"{_INDEX_SQL} SELECT count(*) AS total_words, count(*) FILTER (WHERE n > 1) AS ambiguous_count, (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM index) AS categories FROM words")
def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.index_meta(_index(spark, sf_dir)).withColumn("categories", _joined("categories"))


_CATEGORY_SQL = """e AS (SELECT p.key, p.threshold, 1.0 AS score, i.category, NULL AS how FROM pairs p JOIN index i USING (key)),
s AS (SELECT p.key, p.threshold, i.category, 1.0 - CAST(levenshtein(p.key, i.key) AS DOUBLE) / greatest(length(p.key), length(i.key)) AS score FROM pairs p, index i WHERE p.key NOT IN (SELECT key FROM index)),
n AS (SELECT DISTINCT key, threshold, score, category, NULL AS how FROM (SELECT * FROM s WHERE score >= threshold QUALIFY rank() OVER (PARTITION BY key, threshold ORDER BY score DESC) = 1)),
c AS (SELECT DISTINCT p.key, p.threshold, NULL AS score, i.category, 'containment' AS how FROM pairs p, index i WHERE length(p.key) >= 3 AND contains(i.key, p.key) AND p.key NOT IN (SELECT key FROM index) AND NOT EXISTS (SELECT 1 FROM n WHERE n.key = p.key AND n.threshold = p.threshold)),
u AS (SELECT key, threshold, any_value(score) AS score, any_value(how) AS how, count(*) AS m, string_agg(category, ',' ORDER BY category) AS categories
      FROM (SELECT key, threshold, score, category, how FROM e UNION ALL SELECT key, threshold, score, category, how FROM n UNION ALL SELECT key, threshold, score, category, how FROM c) GROUP BY key, threshold)"""


def _resolved(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = phrases(spark, sf_dir).withColumn("word", F.when(F.pmod("qid", F.lit(10)) == 9, F.substring("phrase", 2, 4)).otherwise(F.col("phrase")))
    found = categories.resolve_categories(rows.drop("phrase", "restrict_category"), _index(spark, sf_dir))
    cats = F.when(F.col("result.category").isNotNull(), F.col("result.category")).otherwise(F.coalesce(_joined("result.candidates"), F.lit("")))
    return found.select("qid", "result.status", cats.alias("categories"), F.round("result.match_score", 3).alias("match_score"), F.col("result.raw_text_passthrough").alias("forwarded"), "result.matched_by", *more)


_RESOLVE_SQL = f"""WITH {CATALOGUE_SQL}, {PHRASES_SQL},
asked AS (SELECT qid, CASE WHEN qid % 10 = 9 THEN substr(phrase, 2, 4) ELSE phrase END AS word, raw_text, threshold FROM phrases),
k AS (SELECT *, array_to_string(regexp_extract_all(lower(translate(word, 'İIƏÇŞĞÖÜ', 'iıəçşğöü')), '[0-9a-zçğıəöüşЀ-ӿ]+'), ' ') AS key FROM asked),
pairs AS (SELECT DISTINCT key, threshold FROM k),
{_CATEGORY_SQL},
res AS (SELECT qid, CASE WHEN m IS NULL THEN 'category_unknown' WHEN m = 1 AND how IS NULL THEN 'category_resolved' ELSE 'category_ambiguous' END AS status, coalesce(categories, '') AS categories,
        round(score, 3) AS match_score, coalesce(nullif(raw_text, ''), word) AS forwarded, how AS matched_by FROM k LEFT JOIN u USING (key, threshold))"""


@query("category_resolve", f"{_RESOLVE_SQL} SELECT * FROM res")
def category_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query("category_question", f"{_RESOLVE_SQL} SELECT qid, CASE WHEN status = 'category_ambiguous' THEN 'К какой категории относится деталь?' END AS question FROM res")
def category_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "result.question").select("qid", "question")


@query("index_source", f"{_INDEX_SQL} SELECT DISTINCT key, category FROM index")
def index_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "index")
    write_category_index(_index(spark, sf_dir), path)
    return read_category_index(spark, path)


@query(
    "index_whole_document",
    f"""{_INDEX_SQL} SELECT 'index' AS part, key, category FROM index UNION ALL SELECT 'ambiguous_words', key, category FROM index JOIN words USING (key) WHERE n > 1
UNION ALL SELECT DISTINCT 'meta', (SELECT count(*) FROM words) || ' ' || (SELECT count(*) FROM words WHERE n > 1), category FROM index""",
)
def index_whole_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "index")
    write_category_index(_index(spark, sf_dir), path)
    found = read_index(spark, path)
    meta = found.meta.select(F.lit("meta").alias("part"), F.concat_ws(" ", "total_words", "ambiguous_count").alias("key"), "category")
    rows = [df.select(F.lit(part).alias("part"), "key", "category") for part, df in (("index", found.index), ("ambiguous_words", found.ambiguous))]
    wrong = found.mismatches().select(F.lit("mismatch").alias("part"), F.col("what").alias("key"), F.col("said").alias("category"))
    return rows[0].unionByName(rows[1]).unionByName(meta).unionByName(wrong)


@query("sql_functions", f"""{_HITS_SQL}, asked AS (SELECT qid, key, raw_text FROM keyed)
SELECT qid, key, h.part_id, h.tier, CASE WHEN raw_text LIKE '%sol%' THEN 'sol' WHEN raw_text LIKE '%Right%' THEN 'sağ' END AS side, CASE WHEN raw_text LIKE '%arxa%' THEN 'arxa' WHEN raw_text LIKE '%front%' THEN 'ön' END AS position
FROM asked LEFT JOIN (SELECT DISTINCT key, part_id, tier FROM hits WHERE tier <= 2) h USING (key)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, catalogue(spark, sf_dir))
    phrases(spark, sf_dir).createOrReplaceTempView("matchloom_phrases")
    return spark.sql("SELECT p.qid, match_key(p.phrase) AS key, e.part_id, e.tier, side_of(p.raw_text) AS side, position_of(p.raw_text) AS position FROM matchloom_phrases p LEFT JOIN LATERAL exact_parts(p.phrase) e")


_ASKED_SQL = "phrases AS (SELECT * FROM (VALUES (1, 'Steel widget', 'sol', 0.9::DOUBLE, NULL::VARCHAR), (2, 'old', NULL, 0.9, NULL), (3, 'no such thing', NULL, 0.9, NULL), (4, 'bolts', NULL, 0.75, NULL)) t(qid, phrase, raw_text, threshold, restrict_category)), " + KEYED_SQL
_ASKED = [("Steel widget", "sol", 0.9), ("old", None, 0.9), ("no such thing", None, 0.9), ("bolts", None, 0.75)]


@query("one_shot_match", _KEPT_SQL.replace(PHRASES_SQL, _ASKED_SQL) + " SELECT phrase, status, res.ids, match_score FROM res JOIN keyed USING (qid)")
def one_shot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = catalogue(spark, sf_dir), []
    for phrase, raw, threshold in _ASKED:
        got = matching.match_one(found, phrase, raw, threshold)
        rows.append((phrase, got["status"], got["part_id"] or ",".join(c["part_id"] for c in got["candidates"]), got.get("match_score")))
    return spark.createDataFrame(rows, "phrase string, status string, ids string, match_score double")


@query("one_shot_resolve", _RESOLVE_SQL.replace(PHRASES_SQL, _ASKED_SQL).replace("CASE WHEN qid % 10 = 9 THEN substr(phrase, 2, 4) ELSE phrase END", "phrase") + " SELECT asked.word, status, res.categories, forwarded FROM res JOIN asked USING (qid)")
def one_shot_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, rows = _index(spark, sf_dir), []
    for word, raw, threshold in _ASKED:
        got = categories.resolve_one(index, word, raw, threshold)
        rows.append((word, got["status"], got.get("category") or ",".join(got.get("candidates", [])), got["raw_text_passthrough"]))
    return spark.createDataFrame(rows, "word string, status string, categories string, forwarded string")


@query("category_exact", f"{_RESOLVE_SQL} SELECT qid, status, categories FROM res WHERE match_score = 1.0")
def category_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("match_score = 1.0").select("qid", "status", "categories")


@query("category_near", f"{_RESOLVE_SQL} SELECT qid, status, categories, match_score FROM res WHERE match_score < 1.0")
def category_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("match_score < 1.0").select("qid", "status", "categories", "match_score")


@query("category_containment", f"{_RESOLVE_SQL} SELECT qid, status, categories FROM res WHERE matched_by = 'containment'")
def category_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("matched_by = 'containment'").select("qid", "status", "categories")


_FUNNEL_SQL = _MATCH_SQL.format(keep="k.only_category IS NULL OR m.category = k.only_category").replace("FROM keyed k JOIN hits", "FROM cat k JOIN hits").replace(
    "cand AS (",
    f"""{_CATEGORY_SQL},
cat AS (SELECT k.*, CASE WHEN m IS NULL THEN 'category_unknown' WHEN m = 1 AND how IS NULL THEN 'category_resolved' ELSE 'category_ambiguous' END AS category_status, CASE WHEN m = 1 AND how IS NULL THEN categories END AS only_category
        FROM keyed k LEFT JOIN u USING (key, threshold)),
cand AS (""",
)


@query(
    "funnel",
    f"""{_FUNNEL_SQL} SELECT qid, category_status, only_category AS category, status,
       CASE WHEN category_status = 'category_ambiguous' THEN 'category' WHEN status = 'ambiguous' THEN 'part' WHEN needs LIKE 'side%' THEN 'side' WHEN needs = 'position' THEN 'position' ELSE 'none' END AS next_question
FROM res JOIN cat USING (qid)""",
)
def funnel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases(spark, sf_dir).drop("restrict_category")
    found = funnel.funnel(rows, catalogue(spark, sf_dir), _index(spark, sf_dir))
    return found.select("qid", F.col("category_result.status").alias("category_status"), "category_result.category", "result.status", "next_question")


_EVENTS_SQL = "e AS (SELECT user_id, event_id, [" + ", ".join(f"'{x}'" for x in funnel.EVENTS) + "][event_id % 7 + 1] AS e, CAST(event_id AS VARCHAR) AS v FROM events)"


def _last_sql(sets: str, clears: str, flag: bool = False) -> str:
    """What the last event that sets or clears a field leaves in it."""
    which = f"FILTER (WHERE e IN ({sets}, {clears}))"
    held = f"coalesce(arg_max(e IN ({sets}), event_id) {which}, FALSE)"
    return held if flag else f"CASE WHEN {held} THEN arg_max(v, event_id) {which} END"


_FOLD_SQL = f"""SELECT user_id AS session, {_last_sql("'cat'", "'cat-other', 'restart'")} AS category, {_last_sql("'part'", "'part-other', 'cat', 'cat-other', 'restart'")} AS part_id,
       {_last_sql("'side'", "'part', 'part-other', 'cat', 'cat-other', 'restart'")} AS side, {_last_sql("'pos'", "'part', 'part-other', 'cat', 'cat-other', 'restart'")} AS position,
       {_last_sql("'cat', 'cat-other'", "'restart'", True)} AS category_said, {_last_sql("'part-other'", "'part', 'cat', 'cat-other', 'restart'", True)} AS part_refused, count(*) AS n_answers FROM e GROUP BY user_id"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, funnel.EVENTS)), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), kind.alias("event"), F.col("event_id").cast("string").alias("value"))


@query("funnel_answers", f"WITH {_EVENTS_SQL} {_FOLD_SQL}")
def funnel_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.fold_answers(_answers(spark, sf_dir))


def _streamed(spark: SparkSession, rows: DataFrame, by: str, files: int = 4) -> DataFrame:
    """A table as a stream of files, two at a time."""
    path = shared_path(spark, "stream")
    rows.repartition(files, by).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("funnel_answers_stream", f"WITH {_EVENTS_SQL} {_FOLD_SQL}")
def funnel_answers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, path = _answers(spark, sf_dir), shared_path(spark, "sessions")
    sessions.fold_to(_streamed(spark, answers, "step"), path, shared_path(spark, "checkpoint")).awaitTermination()
    return sessions.read_sessions(answers, path)


@query("stream_match", f"{_KEPT_SQL} SELECT {_RESULT} FROM res")
def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, path = phrases(spark, sf_dir), catalogue(spark, sf_dir), shared_path(spark, "matched")
    match_to(_streamed(spark, rows, "qid"), found, path, shared_path(spark, "checkpoint")).awaitTermination()
    return _flat(read_matched(rows, found, path)).drop("threshold")


# what each session has said, by p_partkey % 8: (event, value) in turn; $ is the row's p_name
_SAID_EVENTS = {0: [("cat", "heavy")], 1: [("cat-other", None)], 2: [("part", "$")], 3: [("part-other", None)], 4: [("side", "sol")], 5: [("cat", "small"), ("part", "$")], 6: [("part", "$"), ("restart", None)]}

_ANSWERED_SQL = _MATCH_SQL.format(keep="k.only_category IS NULL OR m.category = k.only_category").replace("FROM keyed k JOIN hits", "FROM cat k JOIN hits").replace(
    "cand AS (",
    f"""{_CATEGORY_SQL},
told AS (SELECT p_partkey AS qid, p_partkey % 8 IN (0, 1, 5) AS category_said, CASE p_partkey % 8 WHEN 0 THEN 'heavy' WHEN 5 THEN 'small' END AS said_category,
                CASE WHEN p_partkey % 8 IN (2, 5) THEN p_name END AS said_part, p_partkey % 8 = 3 AS part_refused, CASE WHEN p_partkey % 8 = 4 THEN 'sol' END AS said_side FROM part),
cat AS (SELECT k.*, told.* EXCLUDE (qid), CASE WHEN m IS NULL THEN 'category_unknown' WHEN m = 1 AND how IS NULL THEN 'category_resolved' ELSE 'category_ambiguous' END AS category_status,
               CASE WHEN category_said THEN said_category WHEN m = 1 AND how IS NULL THEN categories END AS only_category FROM keyed k JOIN told USING (qid) LEFT JOIN u USING (key, threshold)),
cand AS (""",
)


@query(
    "funnel_answered",
    f"""{_ANSWERED_SQL},
pick AS (SELECT qid, category_status, only_category, status, side, position, category_said, part_refused, said_side, CASE WHEN status = 'single_match' THEN ids WHEN list_contains(string_split(ids, ','), said_part) THEN said_part END AS chosen FROM res JOIN cat USING (qid))
SELECT qid, category_status, only_category AS category, status, chosen,
       CASE WHEN category_status = 'category_ambiguous' AND NOT category_said THEN 'category' WHEN part_refused THEN 'phrase' WHEN chosen IS NULL AND status = 'ambiguous' THEN 'part'
            WHEN side_flag AND said_side IS NULL AND side IS NULL THEN 'side' WHEN position_flag AND position IS NULL THEN 'position' ELSE 'none' END AS next_question
FROM pick LEFT JOIN parts ON part_id = chosen""",
)
def funnel_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases(spark, sf_dir).drop("restrict_category").withColumn("session", F.col("qid"))
    none = F.array().cast("array<struct<event:string,value:string>>")
    said = F.lit(None)
    for k, events in _SAID_EVENTS.items():
        each = F.array(*[F.struct(F.lit(e).alias("event"), (F.col("p_name") if v == "$" else F.lit(v).cast("string")).alias("value")) for e, v in events])
        said = F.when(F.pmod("p_partkey", F.lit(8)) == k, each).otherwise(said)
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("session"), F.posexplode(F.coalesce(said, none)).alias("step", "said")).select("session", "step", "said.*")
    found = funnel.answered(rows, catalogue(spark, sf_dir), funnel.fold_answers(answers), _index(spark, sf_dir))
    return found.select("qid", F.col("category_result.status").alias("category_status"), F.col("restrict_category").alias("category"), "result.status", "chosen", "next_question")


# --- audits and reports -------------------------------------------------------------------------------


@query("collision_audit", f"WITH {CATALOGUE_SQL} SELECT n.key, string_agg(DISTINCT n.part_id, ',' ORDER BY n.part_id) AS part_ids, string_agg(DISTINCT s.leaf_code, ',' ORDER BY s.leaf_code) AS other_leaves FROM names n JOIN parts USING (part_id) JOIN synonyms s ON s.key = n.key AND s.leaf_code <> parts.leaf_code GROUP BY n.key")
def collision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.collisions(catalogue(spark, sf_dir)).select("key", _joined("part_ids").alias("part_ids"), _joined("other_leaves").alias("other_leaves"))


@query("canonical_report", f"WITH {CATALOGUE_SQL}, h AS (SELECT leaf_ord, leaf_code, lag(category) OVER (ORDER BY leaf_ord) AS before FROM leaves) SELECT h.leaf_ord, p.part_ord, p.category, p.part_id, p.name_az, row_number() OVER (PARTITION BY leaf_ord ORDER BY part_ord) = 1 AND (before IS NULL OR before <> p.category) AS heading FROM parts p JOIN h USING (leaf_code)")
def canonical_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.canonical_names(catalogue(spark, sf_dir)).select(F.col("leaf_ord").cast("long"), F.col("part_ord").cast("long"), "category", "part_id", "name_az", "heading")


_REPORT_SQL = f"""WITH {CATALOGUE_SQL},
h AS (SELECT leaf_ord, leaf_code, category, lag(category) OVER (ORDER BY leaf_ord) AS before FROM leaves),
body AS (SELECT leaf_ord, s, 0 AS o, CASE s WHEN 0 THEN '## ' || category WHEN 1 THEN '' WHEN 2 THEN '### ' || upper(left(leaf_code, 1)) || substr(leaf_code, 2) WHEN 3 THEN '' WHEN 4 THEN '| ID | Canonical Name (AZ) |' WHEN 5 THEN '|----|---------------------|' ELSE '' END AS line
         FROM h, (SELECT unnest([0, 1, 2, 3, 4, 5, 7]) AS s) WHERE s > 1 OR before IS NULL OR before <> category
         UNION ALL SELECT leaf_ord, 6, part_ord, '| ' || part_id || ' | ' || name_az || ' |' FROM parts JOIN h USING (leaf_code)),
every AS (SELECT k AS line_no, line FROM (VALUES (0, '# Canonical names'), (1, ''), (2, '> Generated; do not edit by hand.'), (4, '')) t(k, line)
          UNION ALL SELECT 3, '> ' || (SELECT count(*) FROM parts) || ' parts · ' || (SELECT count(*) FROM leaves) || ' leaves.'
          UNION ALL SELECT row_number() OVER (ORDER BY leaf_ord, s, o) + 4, line FROM body)"""


@query("report_lines", f"{_REPORT_SQL} SELECT CAST(line_no AS INTEGER) AS line_no, line FROM every WHERE line_no <= (SELECT max(line_no) FROM every WHERE line <> '')")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.canonical_lines(catalogue(spark, sf_dir))


@query("report_file", f"{LINES_SQL} SELECT category, subcategory, part_id, name_az FROM file_parts")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "report")
    write_text(reports.canonical_lines(parse_file(spark, _file_catalogue(spark, sf_dir))), path)
    return read_report(spark, path).drop("part_ord")


_HELD_SQL = f"""{_INDEX_SQL},
held AS (SELECT key, CASE WHEN ascii(key) % 3 = 1 THEN categories || ',more' ELSE categories END AS categories FROM words WHERE ascii(key) % 5 <> 0 UNION ALL SELECT 'kept ' || key, categories FROM words WHERE ascii(key) % 5 = 0)"""


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index file as it was once written, and the index as it is now: some words are gone from it, some new, some of other categories."""
    fresh = _index(spark, sf_dir)
    odd = F.ascii("key")
    more = fresh.filter(odd % 3 == 1).select("key", F.lit("more").alias("category"))
    old = fresh.unionByName(more).withColumn("key", F.when(odd % 5 == 0, F.concat(F.lit("kept "), "key")).otherwise(F.col("key"))).filter((odd % 5 != 0) | (F.col("category") != "more"))
    path = shared_path(spark, "index")
    write_category_index(old.distinct(), path)
    joined = lambda index: categories.grouped_index(index).select("key", _joined("categories").alias("categories"))
    return joined(read_category_index(spark, path)), joined(fresh)


@query(
    "report_changes",
    f"""{_HELD_SQL} SELECT coalesce(h.key, w.key) AS key, CASE WHEN h.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'lost' ELSE 'changed' END AS change
FROM held h FULL JOIN words w USING (key) WHERE h.categories IS DISTINCT FROM w.categories""",
)
def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.changes(*_held(spark, sf_dir), ["key"])


@query(
    "report_is_fresh",
    f"""{_HELD_SQL}, differ AS (SELECT count(*) AS n FROM ((SELECT key, categories FROM held EXCEPT SELECT key, categories FROM words) UNION ALL (SELECT key, categories FROM words EXCEPT SELECT key, categories FROM held)))
SELECT 'as written' AS held, (SELECT count(*) FROM (SELECT key, categories FROM words EXCEPT SELECT key, string_agg(category, ',' ORDER BY category) FROM index GROUP BY key)) > 0 AS stale UNION ALL SELECT 'as it was', n > 0 FROM differ""",
)
def report_is_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, fresh = _held(spark, sf_dir)
    return quality.staleness(fresh, fresh, ["key"]).select(F.lit("as written").alias("held"), "stale").unionByName(quality.staleness(held, fresh, ["key"]).select(F.lit("as it was").alias("held"), "stale"))


_JSON_SQL = f"""{_KEPT_SQL},
per_qid AS (SELECT c.qid, list({{'part_id': c.part_id, 'name_ru': c.name_ru, 'name_az': c.name_az}} ORDER BY spot, c.part_id) AS candidates, any_value(name_ru) AS name_ru, any_value(name_az) AS name_az, any_value(category) AS category,
                any_value(upper(left(leaf_code, 1)) || substr(leaf_code, 2)) AS subcategory, any_value(part_id) AS part_id FROM cand c GROUP BY c.qid),
one AS (SELECT r.qid, r.status, r.match_score, r.needs, r.side, r.position, r.status = 'single_match' AS single, s.* EXCLUDE (qid) FROM res r LEFT JOIN per_qid s USING (qid))"""
_JSON_VALUE = """'{"status":"' || status || '",' || concat_ws(',', list_value(
    '"part_id":' || CASE WHEN single THEN to_json(part_id) ELSE 'null' END, '"name_ru":' || CASE WHEN single THEN to_json(name_ru) ELSE 'null' END, '"name_az":' || CASE WHEN single THEN to_json(name_az) ELSE 'null' END,
    '"category":' || CASE WHEN single THEN to_json(category) ELSE 'null' END, '"subcategory":' || CASE WHEN single THEN to_json(subcategory) ELSE 'null' END).list_aggregate('string_agg', ','))
    || ',"attributes":{"side":' || coalesce(to_json(side), 'null') || ',"position":' || coalesce(to_json(position), 'null') || '},"needs_clarification":' || CASE WHEN needs = '' THEN '[]' ELSE to_json(string_split(needs, ',')) END
    || ',"candidates":' || CASE WHEN status = 'ambiguous' THEN to_json(candidates) ELSE '[]' END || CASE WHEN status = 'no_match' THEN '' ELSE ',"match_score":' || to_json(match_score) END || '}'"""


@query("result_json", f"{_JSON_SQL} SELECT qid, {_JSON_VALUE} AS value FROM one")
def results_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(phrases(spark, sf_dir), catalogue(spark, sf_dir)).select("qid", result_json(F.col("result")).alias("value"))


@query("result_file", f"{_KEPT_SQL} SELECT qid, status, match_score FROM res")
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "results")
    write_results(matching.match(phrases(spark, sf_dir), catalogue(spark, sf_dir)).select("qid", "result"), path)
    back = spark.read.schema("qid long, result struct<status: string, match_score: double>").json(path)
    return back.select("qid", "result.status", F.round("result.match_score", 3).alias("match_score"))


@query(
    "index_document",
    f"""{_INDEX_SQL}, g AS (SELECT key, n, '"' || key || '":["' || replace(categories, ',', '","') || '"]' AS entry FROM words)
SELECT '{{"index":{{' || (SELECT string_agg(entry, ',' ORDER BY key) FROM g) || '}},"ambiguous_words":{{' || coalesce((SELECT string_agg(entry, ',' ORDER BY key) FROM g WHERE n > 1), '') || '}},"meta":{{"total_words":' || (SELECT count(*) FROM g)
       || ',"ambiguous_count":' || (SELECT count(*) FROM g WHERE n > 1) || ',"categories":["' || (SELECT string_agg(DISTINCT category, '","' ORDER BY category) FROM index) || '"]}}}}' AS value""",
)
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_document(_index(spark, sf_dir))


@query(
    "catalogue_export",
    f"""WITH {CATALOGUE_SQL}, t AS (SELECT *, '"' || part_id || '":{{"name_ru":"' || name_ru || '","name_az":"' || name_az || '","category":"' || category || '","subcategory":"' || upper(left(leaf_code, 1)) || substr(leaf_code, 2)
       || '","leaf_code":"' || leaf_code || '","side":' || side_flag || ',"position":' || position_flag || '}}' AS entry FROM parts),
g AS (SELECT leaf_code, min(leaf_ord) AS leaf_ord, '"' || leaf_code || '":{{"part_ids":["' || string_agg(part_id, '","' ORDER BY part_ord) || '"]}}' AS entry FROM parts JOIN leaves USING (leaf_code) GROUP BY leaf_code),
s AS (SELECT key, key_ord, '"' || key || '":["' || string_agg(leaf_code, '","' ORDER BY leaf_ord) || '"]' AS entry FROM (SELECT DISTINCT synonyms.key, synonyms.key_ord, leaf_code, leaf_ord FROM synonyms JOIN leaves USING (leaf_code)) GROUP BY key, key_ord)
SELECT '{{"parts":{{' || (SELECT string_agg(entry, ',' ORDER BY part_ord) FROM t) || '}},"groups":{{' || (SELECT string_agg(entry, ',' ORDER BY leaf_ord) FROM g) || '}},"name_index":{{' || (SELECT string_agg('"' || key || '":["' || part_id || '"]', ',' ORDER BY key_ord) FROM names)
       || '}},"synonym_index":{{' || (SELECT string_agg(entry, ',' ORDER BY key_ord) FROM s) || '}}}}' AS value""",
)
def catalogue_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.export(catalogue(spark, sf_dir))


@query("busiest_keys", f"WITH {PHRASES_SQL}, n AS (SELECT key, count(*) AS n FROM keyed GROUP BY key) SELECT key, n, rank() OVER (ORDER BY n DESC) AS place FROM n")
def busiest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = phrases(spark, sf_dir).select(match_key(F.col("phrase")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # keys with more than n rows, summed over the distinct counts, which are few
    more = F.coalesce(F.sum("keys").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).select("n", (more + 1).alias("place"))
    return counts.join(places, "n").select("key", "n", "place")
