"""Batch entity matching against a hierarchical catalogue, on DataFrames only.

The public names, each loaded when it is first asked for:

* catalogues: parse_file, parse_text, parse_texts, Catalogue (save, load), Store (deltas)
* tables of phrases: match, resolve_categories, category_index, funnel; streams: match_to, fold_to
* one phrase: Matcher, CategoryMatcher, match_one, resolve_one
* SQL: register, which adds functions to a session
"""

from importlib import import_module

_PLACES = {
    "Catalogue": "sources.catalogue", "parse_file": "sources.catalogue", "parse_text": "sources.catalogue", "parse_texts": "sources.catalogue", "Store": "sources.deltas",
    "match": "operators.matching", "match_one": "operators.matching", "NearIndex": "operators.near", "near_keys": "operators.near",
    "category_index": "operators.categories", "resolve_categories": "operators.categories", "resolve_one": "operators.categories",
    "funnel": "operators.funnel", "fold_answers": "operators.funnel", "answered": "operators.funnel", "collisions": "operators.quality", "changes": "operators.quality",
    "match_to": "streaming.phrases", "match_stream": "streaming.phrases", "fold_to": "streaming.sessions",
    "Matcher": "session", "CategoryMatcher": "session", "register": "session",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_PLACES[name]}", __name__), name)
