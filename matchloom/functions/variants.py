"""Name variants and subcategory names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the catalogue's grammar understands it, for use inside brackets.
SPACE = "\\s\\x1c-\\x1f"
_CYRILLIC = "[А-Яа-яЁё]"
_INNER = "\\(([^)]*)\\)"
MOST_COMBINATIONS = 16


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def _split(text: Column, pattern: str) -> Column:
    return F.split(text, f"(?U){pattern}")


def subcategory_of(leaf_name: Column) -> Column:
    """A leaf's name without the new mark and without trailing segments in Cyrillic (the first always stays)."""
    parts = _split(stripped(F.replace(leaf_name, F.lit("🆕"))), f"[{SPACE}]+/[{SPACE}]+")
    last = F.array_max(F.transform(parts, lambda x, k: F.when(x.rlike(_CYRILLIC), 0).otherwise(k + 1)))
    return stripped(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), last)), " / "))


def slash_expansion(name: Column) -> Column:
    """All choices of one alternative at each a/b of a name, brackets left out.

    Empty unless some word has alternatives, the name has two words at least, and there are at most 16
    combinations.
    """
    base = F.regexp_replace(F.regexp_replace(name, _INNER, " "), f"(?U)[{SPACE}]*/[{SPACE}]*", "/")
    tokens = F.filter(_split(base, f"[{SPACE}]+"), lambda t: t != "")

    def alternatives(token: Column) -> Column:
        own = F.filter(F.split(token, "/"), lambda p: p != "")
        return F.when(F.size(own) > 0, own).otherwise(F.array(token))

    options = F.transform(tokens, alternatives)
    product = F.aggregate(options, F.lit(1.0), lambda n, o: n * F.size(o))
    several = F.exists(options, lambda o: F.size(o) > 1)
    start = F.coalesce(F.get(options, F.lit(0)), F.array().cast("array<string>"))
    grown = F.aggregate(
        F.slice(options, F.lit(2), F.greatest(F.size(options) - 1, F.lit(0))),
        start,
        lambda done, o: F.flatten(F.transform(done, lambda a: F.transform(o, lambda b: F.concat(a, F.lit(" "), b)))),
    )
    none = F.array().cast("array<string>")
    return F.when(several & (F.size(tokens) >= 2) & (product <= MOST_COMBINATIONS), F.array_distinct(grown)).otherwise(none)


def name_variants(name: Column) -> Column:
    """The whole name, what stands in brackets, each alternative there, and the slash expansion; sorted.

    The name without its brackets is not a variant of its own.
    """
    name = stripped(name)
    inner = F.filter(F.transform(F.regexp_extract_all(name, F.lit(_INNER), 1), stripped), lambda x: x != "")
    choices = F.flatten(F.transform(inner, lambda x: F.transform(_split(x, f"[{SPACE}]*/[{SPACE}]*"), stripped)))
    every = F.concat(F.array(name), inner, choices, slash_expansion(name))
    return F.array_sort(F.array_distinct(F.filter(every, lambda v: v != "")))
