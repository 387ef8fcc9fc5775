"""A catalogue at hand in a session: single phrases from Python, and functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.attributes import FRONT, LEFT, REAR, RIGHT
from .functions.text import _LETTERS
from .operators.categories import category_index, resolve_categories, resolve_one
from .operators.matching import THRESHOLD, match, match_one
from .sources.catalogue import Catalogue, parse_file
from .sources.files import read_index


class Matcher:
    """A catalogue that is kept for many calls. A table of phrases is matched as one."""

    def __init__(self, catalogue: Catalogue):
        self.catalogue = catalogue.persist()

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Matcher:
        return cls(parse_file(spark, path))

    def match(self, phrases: str | DataFrame, raw_text: str | None = None, threshold: float = THRESHOLD, restrict_category: str | None = None) -> dict | DataFrame:
        """One phrase's result as a dictionary, or a table with results. (A table has its own parameters, as columns.)"""
        if isinstance(phrases, DataFrame):
            return match(phrases, self.catalogue)
        return match_one(self.catalogue, phrases, raw_text, threshold, restrict_category)

    def close(self) -> None:
        self.catalogue.unpersist()


class CategoryMatcher:
    """A category index that is kept for many calls."""

    def __init__(self, index: DataFrame):
        self.index = index.persist()

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> CategoryMatcher:
        """Of an index file (JSON)."""
        return cls(read_index(spark, path).index)

    @classmethod
    def from_catalogue(cls, catalogue: Catalogue) -> CategoryMatcher:
        return cls(category_index(catalogue))

    def resolve(self, words: str | DataFrame, raw_text: str | None = None, threshold: float = THRESHOLD) -> dict | DataFrame:
        """One word's result as a dictionary, or a table with results."""
        if isinstance(words, DataFrame):
            return resolve_categories(words, self.index)
        return resolve_one(self.index, words, raw_text, threshold)

    def close(self) -> None:
        self.index.unpersist()


def _direction(first: list[str], one: str, second: list[str], two: str) -> str:
    has = lambda names: "arrays_overlap(words_of(t), array(" + ", ".join(f"'{n}'" for n in names) + "))"
    return f"CASE WHEN {has(first)} AND {has(second)} THEN '{one},{two}' WHEN {has(first)} THEN '{one}' WHEN {has(second)} THEN '{two}' END"


def register(spark: SparkSession, catalogue: Catalogue | None = None) -> None:
    """Add functions to a session's SQL; their bodies are plain SQL, so Spark plans them with the query.

    match_key(text), words_of(text), similarity_of(a, b), side_of(text), position_of(text); with a catalogue
    also the view matchloom_parts and the table functions exact_parts(phrase) (the parts of the tier of exact names or synonyms, in order: at)
    and exact_categories(word). They are joined by key where they are used with LATERAL.
    """
    spaced = f"regexp_replace(t, '[^{_LETTERS}]+', ' ')"
    bodies = {
        "match_key(t STRING) RETURNS STRING": f"btrim(lower(replace(replace({spaced}, 'İ', 'i'), 'I', 'ı')))",
        "words_of(t STRING) RETURNS ARRAY<STRING>": "array_remove(split(match_key(t), ' '), '')",
        "similarity_of(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1D - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END",
        "side_of(t STRING) RETURNS STRING": _direction(LEFT, "sol", RIGHT, "sağ"),
        "position_of(t STRING) RETURNS STRING": _direction(FRONT, "ön", REAR, "arxa"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    if catalogue is None:
        return
    catalogue.parts.createOrReplaceTempView("matchloom_parts")
    catalogue.lookup.createOrReplaceTempView("matchloom_lookup")
    category_index(catalogue).createOrReplaceTempView("matchloom_categories")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION exact_parts(phrase STRING) RETURNS TABLE (tier INT, at ARRAY<BIGINT>, part_id STRING, name_ru STRING, name_az STRING, category STRING)
        RETURN SELECT tier, at, part_id, name_ru, name_az, category FROM matchloom_lookup JOIN matchloom_parts USING (part_id) WHERE key = match_key(exact_parts.phrase)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION exact_categories(word STRING) RETURNS TABLE (category STRING)
        RETURN SELECT category FROM matchloom_categories WHERE key = match_key(exact_categories.word)""")
