"""Text normalisation and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capitals whose Azerbaijani lower case differs from the default, or is mapped first.
AZ_UPPER = "İIƏÇŞĞÖÜ"
AZ_LOWER = "iıəçşğöü"

# Fixed value: the letters and digits of a word (Latin, Azerbaijani, Cyrillic).
_LETTERS = "0-9a-zçğıəöüşA-ZÇĞİIƏÖÜŞ\\u0400-\\u04FF"


def lower_az(text: Column) -> Column:
    """Lower case with dotted and dotless i told apart. (`lower` alone turns İ into two code points.)

    The other capitals of AZ_UPPER are lowered by `lower` as they are.
    """
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def _spaced(text: Column) -> Column:
    return lower_az(F.regexp_replace(text, f"[^{_LETTERS}]+", " "))


def match_key(text: Column) -> Column:
    """The form under which names and phrases are compared: the words, lower-cased, one space between.

    Whatever is no word becomes a space first, so one pass lowers the whole string.
    """
    return F.btrim(_spaced(text))


def words(text: Column) -> Column:
    """The lower-cased words of a text; everything else separates."""
    return F.array_remove(F.split(_spaced(text), " "), "")


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """1 - edit distance / longer length, in code points; two empty texts are the same."""
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b) if distance is None else distance
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - distance.cast("double") / F.nullif(longest, F.lit(0)).cast("double"))


def round3(score: Column) -> Column:
    """A score (0.001 to 1) to three places, from its exact binary value, ties to even.

    Spark's own rounding starts from the shortest decimal form and so takes some scores just under a half
    for ties. A double from 0.001 to 1 times 2**62 is a whole number, and the rest is whole-number arithmetic.
    """
    wide = "decimal(38,0)"
    exact = (score * float(2**62)).cast("bigint").cast(wide)
    thousand = exact * F.lit(1000).cast(wide)
    down = F.call_function("div", thousand, F.lit(2**62).cast(wide)).cast("bigint")
    rest = thousand.cast(wide) - down.cast(wide) * F.lit(2**62).cast(wide)
    half = F.lit(2**61).cast(wide)
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    return (down + up.cast("bigint")).cast("double") / 1000.0
