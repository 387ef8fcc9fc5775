"""Side and position words in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# The words of each direction.
LEFT = [
    "sol", "sola", "soldan", "soldakı", "soldaki", "left", "lh", "лево", "левый", "левая", "левое", "левых", "левого", "слева",
]
RIGHT = [
    "sağ", "sag", "sağa", "sağdan", "sagdan", "sağdakı", "sagdaki", "right", "rh", "право", "правый", "правая", "правое", "правых", "правого", "справа",
]
FRONT = [
    "ön", "öndeki", "öndəki", "önki", "qabaq", "qabağ", "qabaqdakı", "qabaqdaki", "qabağdakı", "front", "fr", "перед", "передний", "передняя", "переднее", "передних", "переднего", "спереди", "speredi",
]
REAR = [
    "arxa", "arxadakı", "arxadaki", "arxadan", "arxadaku", "rear", "back", "зад", "задний", "задняя", "заднее", "задних", "заднего", "сзади",
]


def _found(text: Column, first: list[str], first_name: str, second: list[str], second_name: str) -> Column:
    tokens = words(text)
    has = [F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, names))), F.lit(False)) for names in (first, second)]
    return F.when(has[0] & has[1], f"{first_name},{second_name}").when(has[0], first_name).when(has[1], second_name)


def side(text: Column) -> Column:
    """sol, sağ, both as "sol,sağ", or null."""
    return _found(text, LEFT, "sol", RIGHT, "sağ")


def position(text: Column) -> Column:
    """ön, arxa, both as "ön,arxa", or null."""
    return _found(text, FRONT, "ön", REAR, "arxa")


def search_space(phrase: Column, raw_text: Column) -> Column:
    """The phrase and the raw text, of those that are not empty."""
    return F.concat_ws(" ", F.nullif(phrase, F.lit("")), F.nullif(raw_text, F.lit("")))


def passthrough(word: Column, raw_text: Column) -> Column:
    """The raw text as it is, or the word where that is null or empty."""
    return F.coalesce(F.nullif(raw_text, F.lit("")), word)
