"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and an end-of-word mark. A node's failure link leads to where
matching goes on once the greedy longest pieces of its string are popped, and its pop count says how
many those are; both are worked out once for each node. Counting a word then takes one step a byte, and
no piece is ever built.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare
from .token_output import _MOST_KNOWN, _PIECE, _PLAIN, byte_alphabet, encoder

_END = 256
_ROOT = 0
_NONE = -1


def pieces_of(vocabulary: dict[str, int], suffix: str = "</w>") -> list[tuple[int, ...]]:
    """A byte-level vocabulary's pieces as bytes, with the end mark where a piece ends a word."""
    known, out = byte_alphabet(), []
    for piece in vocabulary:
        last = suffix and piece.endswith(suffix) and piece != suffix
        body = piece[: -len(suffix)] if last else piece
        if body and all(c in known for c in body):
            out.append((*(known[c] for c in body), *[_END] * bool(last)))
    return out


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]):
        steps: dict[int, int] = {}
        parent, by, whole = [_NONE], [0], [False]
        for piece in pieces:
            node = _ROOT
            for c in piece:
                key = node * 257 + c
                if key not in steps:
                    steps[key] = len(parent)
                    parent.append(node)
                    by.append(c)
                    whole.append(False)
                node = steps[key]
            whole[node] = True
        children: dict[int, list[int]] = {}
        for node in range(1, len(parent)):
            children.setdefault(parent[node], []).append(node)
        fail, pops = [_NONE] * len(parent), [0] * len(parent)
        queue = deque(children.get(_ROOT, []))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, []))
            if whole[node]:
                fail[node], pops[node] = _ROOT, 1
                continue
            at, popped = fail[parent[node]], pops[parent[node]]
            while at != _NONE and at * 257 + by[node] not in steps:
                popped += pops[at]
                at = fail[at]
            if at != _NONE:
                fail[node], pops[node] = steps[at * 257 + by[node]], popped
        self.steps, self.fail, self.pops = steps, fail, pops
        self.end = [_END] * any(_END in piece for piece in pieces)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of a word, or 0 where it has none."""
        steps, fail, pops = self.steps, self.fail, self.pops
        node, n = _ROOT, 0
        for c in (*word, *self.end):
            to = steps.get(node * 257 + c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node == _NONE:
                    return 0
                to = steps.get(node * 257 + c)
            node = to
        while node != _ROOT:
            n += pops[node]
            node = fail[node]
            if node == _NONE:
                return 0
        return n


class Counter:
    """Words of a text by the file's own normalizer and pre-tokenizer, and their counts by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.automaton = Automaton(pieces_of(model["vocab"], model.get("end_of_word_suffix") or ""))
        self.model, self.known_split = encoder(path).model, encoder(path).known_split
        self.letters = byte_alphabet()
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> list[bytes]:
        if self.known_split and _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            # beyond ASCII, bytes.lower leaves letters alone; the file's normalizer lowers them as str.lower does here
            return _PIECE.findall(text.lower().encode())
        normal = self.model.normalizer.normalize_str(text) if self.model.normalizer else text
        return [bytes(self.letters[c] for c in piece) for piece, _ in self.model.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, pieces, and words without a split (each counts as one piece)."""
        words, known = self.words(text), self.known
        try:
            got = [known[w] for w in words]
        except KeyError:
            if len(known) > _MOST_KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.automaton.count(w)
            got = [known[w] for w in words]
        unknown = got.count(0)
        return len(words), sum(got) + unknown, unknown


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            rows = [(0, 0, 0) if not t.is_valid else c.count(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every whole text.

    n_tokens are the pieces of the greedy longest-match split over the vocabulary of the tokenizer file.
    A word without a split counts as one token, and in n_unknown. Null and empty texts have no words.
    Every row gives one row (repeated rows, ties and null ids stay), an empty table gives none, and other
    columns are left out, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(tokenizer), "doc_id long, n_words long, n_tokens long, n_unknown long")
