"""Language identification by unigram piece models summed over all segmentations.

The pieces are those of a fixed public vocabulary, as bytes, and every single byte. A language gives each
piece a probability. The probability of a word is the sum over all its segmentations of the product of
their pieces' probabilities, which a forward pass over the word's bytes adds up; a text's is the product
over its words. The model is fitted by expectation maximisation (forward and backward passes) on word
counts of labelled texts.

Words are those of textbytes (ASCII letters lower-cased), of any length. The passes over words of at most 48
bytes work on probabilities; over longer ones, which would leave the range of doubles, on their logarithms.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .memory import trimmed
from .storage import prepare
from .textbytes import _CODES, _LOWER, _STEP, chunks, mixed, text_bytes, word_hashes

UNKNOWN = "und"
_SHORT = 48
_AT_ONCE = 8192
_BYTES_AT_ONCE = 1 << 19


def public_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece file as bytes, lower-cased and without word-start marks; and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            raw = model.id_to_piece(k).replace("▁", "").encode().lower()
            if raw:
                found.add(raw)
    return sorted(found)


class Lattice:
    """All pieces in all places of some words, in the order in which passes need them."""

    def __init__(self, pieces: "Pieces", words: tuple[np.ndarray, np.ndarray]):
        body, offsets = words
        n = len(body)
        self.offsets, self.sizes = offsets, np.diff(offsets)
        within = np.arange(n) - np.repeat(offsets[:-1], self.sizes)
        left = np.repeat(offsets[1:], self.sizes) - np.arange(n)
        at, key = np.arange(n), np.zeros(n, np.uint64)
        starts, lengths, ids = [], [], []
        for size in range(1, pieces.longest + 1):
            keep = left[at] >= size
            at, key = at[keep], key[keep]
            if not len(at):
                break
            key = (key * _STEP) + _CODES[body[at + size - 1]]
            keep = pieces.is_prefix(key, size)
            at, key = at[keep], key[keep]
            found = pieces.find(key, size)
            hit = found >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), size))
            ids.append(found[hit])
        self.n = n
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.piece = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        # positions before and after bytes: word w has sizes[w] + 1 of them
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.start] if n else np.zeros(0, np.int64)
        self.begin = self.start + word
        self.end = self.begin + self.length
        self.head = offsets[:-1] + np.arange(len(self.sizes))
        self.last = self.head + self.sizes
        behind = within[self.start] + self.length if n else np.zeros(0, np.int64)
        self.by_end = np.argsort(behind * (n + len(self.sizes) + 1) + self.end, kind="stable")
        longest = int(self.sizes.max(initial=0))
        self.end_steps = np.searchsorted(behind[self.by_end], np.arange(1, longest + 2))
        before = within[self.start] if n else np.zeros(0, np.int64)
        self.by_begin = np.argsort(before * (n + len(self.sizes) + 1) + self.begin, kind="stable")
        self.begin_steps = np.searchsorted(before[self.by_begin], np.arange(0, longest + 1))

    def _pass(self, order, steps, into, out_of, seeds, p, logs: bool) -> np.ndarray:
        """Sums of products of p (of logs: of its logarithms, and logarithms of sums) along all ways from the seeds."""
        sums = np.full((self.n + len(self.sizes), p.shape[1]), -np.inf if logs else 0.0)
        sums[seeds] = 0.0 if logs else 1.0
        for a, z in steps:
            if a < z:
                e = order[a:z]
                terms = sums[out_of[e]] + p[self.piece[e]] if logs else sums[out_of[e]] * p[self.piece[e]]
                to = into[e]
                new = np.r_[True, to[1:] != to[:-1]]
                heads = np.flatnonzero(new)
                if logs:
                    top = np.maximum.reduceat(terms, heads, axis=0)
                    sums[to[heads]] = top + np.log(np.add.reduceat(np.exp(terms - top[np.cumsum(new) - 1]), heads, axis=0))
                else:
                    sums[to[heads]] += np.add.reduceat(terms, heads, axis=0)
        return sums

    def forward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        """Sums over segmentations up to each position; p has a row a piece and a column a language."""
        return self._pass(self.by_end, list(zip(self.end_steps, [*self.end_steps[1:], len(self.by_end)])), self.end, self.begin, self.head, p, logs)

    def backward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        pairs = list(zip(self.begin_steps, [*self.begin_steps[1:], len(self.by_begin)]))
        return self._pass(self.by_begin, pairs[::-1], self.begin, self.end, self.last, p, logs)

    @property
    def _logs(self) -> bool:
        return int(self.sizes.max(initial=0)) > _SHORT

    def log_probability(self, p: np.ndarray, log_p: np.ndarray | None = None) -> np.ndarray:
        if self._logs:
            return self.forward(np.log(p) if log_p is None else log_p, True)[self.last]
        return np.log(np.maximum(self.forward(p)[self.last], 1e-300))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words of each language; counts has a row a word."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.start]
        if self._logs:
            log_p = np.log(p)
            ahead, back = self.forward(log_p, True), self.backward(log_p, True)
            uses = np.exp(ahead[self.begin] + log_p[self.piece] + back[self.end] - ahead[self.last][word]) * counts[word]
        else:
            ahead, back = self.forward(p), self.backward(p)
            share = counts / np.maximum(ahead[self.last], 1e-300)
            uses = ahead[self.begin] * p[self.piece] * back[self.end] * share[word]
        return np.stack([np.bincount(self.piece, uses[:, k], len(p)) for k in range(p.shape[1])], axis=1)


def _portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of words to be worked on together: short ones, then long ones by size, each portion of bounded bytes."""
    order = np.argsort(np.where(sizes <= _SHORT, 0, sizes), kind="stable")
    cut = int((sizes <= _SHORT).sum())
    for a in range(0, cut, _AT_ONCE):
        yield order[a : min(a + _AT_ONCE, cut)]
    first, held = cut, 0
    for k in range(cut, len(order)):
        if held and held + sizes[order[k]] > _BYTES_AT_ONCE:
            yield order[first:k]
            first, held = k, 0
        held += int(sizes[order[k]])
    if first < len(order):
        yield order[first:]


def _gathered(body: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of some words end to end, and where each begins (one more at the end)."""
    offsets = np.r_[0, np.cumsum(sizes)]
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)
    return _LOWER[body[at]], offsets


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum(sizes)]


class Pieces:
    """A vocabulary that finds pieces, and beginnings of pieces, by hash (distinct for this vocabulary)."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.full, self.part = {}, {}
        for k, piece in enumerate(pieces):
            self.full.setdefault(len(piece), []).append((self._key(piece), k))
            for size in range(1, len(piece) + 1):
                self.part.setdefault(size, set()).add(self._key(piece[:size]))
        for size, rows in self.full.items():
            rows.sort()
            self.full[size] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
            if len(np.unique(self.full[size][0])) != len(rows):
                raise ValueError("two pieces share a hash")
        self.part = {size: np.array(sorted(keys), np.uint64) for size, keys in self.part.items()}

    @staticmethod
    def _key(piece: bytes) -> int:
        key = 0
        for b in piece:
            key = (key * int(_STEP) + int(_CODES[b])) & 0xFFFFFFFFFFFFFFFF
        return key

    def is_prefix(self, key: np.ndarray, size: int) -> np.ndarray:
        return _place(self.part.get(size), key) >= 0

    def find(self, key: np.ndarray, size: int) -> np.ndarray:
        if size not in self.full:
            return np.full(len(key), -1)
        keys, ids = self.full[size]
        at = _place(keys, key)
        return np.where(at >= 0, ids[at], -1)


@functools.lru_cache(1)
def _index_of(pieces: tuple[bytes, ...]) -> Pieces:
    return Pieces(list(pieces))


def _place(keys: np.ndarray | None, wanted: np.ndarray) -> np.ndarray:
    if keys is None:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    p: np.ndarray  # a row a piece, a column a language

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.index, self.log_p = model, Pieces(model.pieces), np.log(model.p)

    def texts(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each text in each language, and its number of words."""
        out, words = np.zeros((len(offsets) - 1, len(self.model.langs))), np.zeros(len(offsets) - 1, np.int64)
        for a, z in chunks(offsets, 8 << 20):
            hashes, first, last, before = word_hashes(body[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            words[a:z] = np.diff(before)
            if not len(hashes):
                continue
            _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
            scores = self.words(body[offsets[a] : offsets[z]], first[where], last[where])
            text = np.repeat(np.arange(z - a), words[a:z])
            for k in range(out.shape[1]):
                out[a:z, k] = np.bincount(text, scores[which, k], z - a)
        return out, words

    def words(self, body: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), len(self.model.langs)))
        for at in _portions(last - first):
            lattice = Lattice(self.index, _gathered(body, first[at], (last - first)[at]))
            out[at] = lattice.log_probability(self.model.p, self.log_p)
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        body, offsets = text_bytes(batch.column(0))
        hashes, first, last, before = word_hashes(body, offsets)
        if not len(hashes):
            continue
        names = sorted(set(langs))
        code = np.repeat(np.array([names.index(x) for x in langs], np.uint64), np.diff(before))
        _, where, counts = np.unique(mixed(hashes ^ mixed(code + np.uint64(1))), return_index=True, return_counts=True)
        raw = body.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[int(c)] for c in code[where]]), pa.array([raw[a:z].lower() for a, z in zip(first[where], last[where])], pa.binary()), pa.array(counts, pa.int64())],
            ["lang", "word", "n"],
        )


def fit(labelled: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows_per_lang: int = 2000, rounds: int = 3) -> Model | None:
    """Fit the piece probabilities on labelled rows.

    The fit takes a bounded sample: about rows_per_lang rows of each language, chosen by a hash of
    key_col and the text, and all words of those rows. Each language is fitted by itself, in one task, and
    only its probabilities reach the driver. Rows with a null text or language are passed over. Without any labelled row
    there is no model (None). The model has a number for each piece and language, and goes to every task.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(key_col), F.col(text_col)).alias("h")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_lang / n))])
    sample = rows.filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < F.element_at(shares, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(trimmed(_word_counts), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs, pieces = sorted(sizes), public_pieces(vocabulary)
    fitted = counts.groupBy("lang").applyInArrow(_fit_language(pieces, rounds), "lang string, p array<double>").toArrow()
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))  # a language without words stays at this
    for lang, column in zip(fitted.column("lang").to_pylist(), fitted.column("p")):
        p[:, langs.index(lang)] = column.values.to_numpy()
    return Model(langs, pieces, p)


def _fit_language(pieces: list[bytes], rounds: int):
    def run(table: pa.Table) -> pa.Table:
        pairs = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        counts = np.array([n for _, n in pairs], float)[:, None]
        p = _maximise(pieces, [w for w, _ in pairs], counts, rounds)[:, 0]
        return pa.table({"lang": table.column("lang").slice(0, 1), "p": pa.array([p], pa.list_(pa.float64()))})

    return run


def _maximise(pieces: list[bytes], words: list[bytes], counts: np.ndarray, rounds: int) -> np.ndarray:
    index, sizes = _index_of(tuple(pieces)), np.array([len(p) for p in pieces])
    body, offsets = _joined(words)
    lengths = np.diff(offsets)
    p = np.repeat((0.1**sizes / np.sum(0.1**sizes))[:, None], counts.shape[1], axis=1)
    for _ in range(rounds if words else 0):
        uses = np.full(p.shape, 0.01)
        for at in _portions(lengths):
            uses += Lattice(index, _gathered(body, offsets[at], lengths[at])).expected(p, counts[at])
        p = uses / uses.sum(0)
    return p


def _predict(model: Model | None):
    def start():
        scorer = model.scorer() if model else None

        def label(texts: pa.Array) -> list[pa.Array]:
            body, offsets = text_bytes(texts)
            lettered = np.array([t.is_valid and any(map(str.isalpha, t.as_py())) for t in texts], bool)
            langs = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            if scorer and lettered.any():
                got, _ = scorer.texts(body, offsets)
                got -= got.max(1, keepdims=True)
                share = np.exp(got)
                share /= share.sum(1, keepdims=True)
                best = got.argmax(1)
                langs[lettered] = np.array(model.langs, object)[best[lettered]]
                score[lettered] = share[np.arange(len(best)), best][lettered]
            return [pa.array(langs, pa.string()), pa.array(score)]

        return label

    return start


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language of every whole text, and its posterior probability (0 to 1).

    A text that is null or has no letter (Unicode category L) is "und" with score 0; so is every text without a model. Equal
    probabilities go to the first language by name. All rows and columns stay (repeated rows, ties, null
    ids); an empty table stays empty. A column called pred_col or score_col gives way.
    """
    return add_columns(docs, [text_col], _predict(model), f"{pred_col} string, {score_col} double")
