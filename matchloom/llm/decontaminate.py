"""Benchmark decontamination by suffix arrays of the training documents.

Documents come in shards of a few megabytes. A shard's suffix array is built over all words of its documents,
whatever the benchmark is, each document ended by a code of its own. Every benchmark suffix is then found by
binary search in every shard. What a suffix of 2h words matches is a range inside that of its first h words,
in the order of what follows them, and its bounds are those of the range of its other h words; so ranges
double, no text is compared, and an item's length adds only its logarithm.

The ranges give each benchmark suffix's longest verbatim match in the shard and where it is, each
document's longest match, and all occurrences of the benchmark's windows. Occurrences are then checked
word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .storage import prepare, remove, written
from .suffixes import common_prefixes, suffix_array
from .textbytes import chunks, text_bytes, word_hashes, words_hashed, words_of

WINDOW = 10
#: Most words of benchmark items that go to the tasks at once (one longer item goes by itself).
BLOCK_WORDS = 250_000
#: Bytes of text in a shard (one longer document is a shard of its own).
SHARD_BYTES = 4 << 20


@dataclass
class Block:
    """Some benchmark items, ready to be searched for."""

    items: list[str]
    hashes: np.ndarray  # of all items' words end to end, and of nothing behind each item
    item: np.ndarray  # the item of each of them
    left: np.ndarray  # words from each to the end of its item
    windows: list[tuple[str, ...]]  # each once, however many items have it
    at: np.ndarray  # where each begins in one item that has it
    list_of: np.ndarray  # which list of items has it
    lists: list[np.ndarray]


def block_of(items: list[tuple[str, str]], window: int = WINDOW) -> Block:
    every, item, left, holders, at = [], [], [], {}, {}
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        base, n = len(every), len(words)
        every += [*words, ""]
        item += [k] * (n + 1)
        left += range(n, -1, -1)
        wide = min(window, n)
        for i in range(n - wide + 1) if n else ():
            own = tuple(words[i : i + wide])
            at.setdefault(own, base + i)
            held = holders.setdefault(own, [])
            if not held or held[-1] != k:
                held.append(k)
    rest = np.array(left, np.int64)
    hashes = np.zeros(len(every), np.uint64)
    hashes[rest > 0] = words_hashed([w for w in every if w])
    numbers: dict[tuple[int, ...], int] = {}
    list_of = [numbers.setdefault(tuple(held), len(numbers)) for held in holders.values()]
    return Block([k for k, _ in items], hashes, np.array(item, np.int64), rest, list(holders), np.array([at[w] for w in holders], np.int64), np.array(list_of, np.int64), [np.array(x, np.int64) for x in numbers])


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """All items in blocks of at most so many words, one at a time. The benchmark is read row by row."""
    held, size, made = [], 0, False
    for key, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        n = len(words_of(text))
        if held and size + n > most:
            yield block_of(held, window)
            held, size, made = [], 0, True
        if n:
            held.append((key, text))
            size += n
    if held or not made:
        yield block_of(held, window)


class Shard:
    """The suffix array of some documents' words."""

    def __init__(self, hashes: np.ndarray, before: np.ndarray):
        docs = len(before) - 1
        self.known, number = np.unique(hashes, return_inverse=True)
        doc = np.repeat(np.arange(docs), np.diff(before))
        self.codes = np.zeros(len(hashes) + docs, np.int64)
        self.position = np.full(len(self.codes), -1)
        slot = np.arange(len(hashes)) + doc
        self.codes[slot], self.position[slot] = number.ravel() + 1, np.arange(len(hashes))
        self.codes[before[1:] + np.arange(docs)] = len(self.known) + 1 + np.arange(docs)
        top = len(self.known) + docs + 1
        self.order, self.ranks = suffix_array(self.codes, len(self.codes) + 1, 3 if top < 1 << 21 else 2 if top < 1 << 32 else 1)
        self.first = self.codes[self.order]

    def range_of_word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with each of some words."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        code = np.where(self.known[at] == hashes, at + 1, 0)
        return np.searchsorted(self.first, code), np.searchsorted(self.first, code, side="right")

    def narrowed(self, low: np.ndarray, high: np.ndarray, shift: np.ndarray | int, to_low: np.ndarray, to_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes from low to high, which share their first shift words: those that go on within to_low to to_high."""
        shift = np.broadcast_to(shift, low.shape)

        def bound(target: np.ndarray) -> np.ndarray:
            a, z = low.copy(), high.copy()
            live = np.flatnonzero(a < z)
            while len(live):
                mid = (a[live] + z[live]) // 2
                less = self.ranks[self.order[mid] + shift[live]] < target[live]
                a[live[less]] = mid[less] + 1
                z[live[~less]] = mid[~less]
                live = live[a[live] < z[live]]
            return a

        return bound(to_low), bound(to_high)

    def search(self, block: Block) -> "Matches":
        return Matches(self, block)


class Matches:
    """The ranges of all suffixes of a block: levels[k] has those of their first 2 ** k words (empty: none)."""

    def __init__(self, shard: Shard, block: Block):
        self.shard, self.block = shard, block
        low, high = shard.range_of_word(block.hashes)
        none = block.left == 0
        low[none] = high[none] = 0
        self.levels, half = [(low, high)], 1
        while True:
            live = np.flatnonzero((block.left >= 2 * half) & (high > low))
            live = live[high[live + half] > low[live + half]]
            next_low, next_high = np.zeros_like(low), np.zeros_like(high)
            if len(live):
                next_low[live], next_high[live] = shard.narrowed(low[live], high[live], half, low[live + half], high[live + half])
            if not (next_high > next_low).any():
                break
            low, high, half = next_low, next_high, 2 * half
            self.levels.append((low, high))

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix: the words of its longest match, and the range of shard suffixes that have it."""
        left = self.block.left
        words, low, high = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.full(len(left), len(self.shard.order))
        for k in reversed(range(len(self.levels))):
            self._go_on(k, np.flatnonzero(left - words >= 1 << k), words, low, high)
        return words, low, high

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The range of shard suffixes that begin with each window."""
        at = self.block.at
        size = np.array([len(w) for w in self.block.windows], np.int64)
        words, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), len(self.shard.order))
        for k in reversed(range(int(size.max(initial=0)).bit_length())):
            if k < len(self.levels):
                self._go_on(k, np.flatnonzero(size >> k & 1), words, low, high, at)
        whole = words == size
        return np.where(whole, low, 0), np.where(whole, high, 0)

    def _go_on(self, k: int, which: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray | None = None) -> None:
        """Take 2 ** k more words into the matches of some suffixes, where they have them."""
        base = which if start is None else start[which]
        to_low, to_high = (x[base + words[which]] for x in self.levels[k])
        some = to_high > to_low
        which, to_low, to_high = which[some], to_low[some], to_high[some]
        begun = words[which] > 0
        new_low, new_high = to_low.copy(), to_high.copy()
        new_low[begun], new_high[begun] = self.shard.narrowed(low[which[begun]], high[which[begun]], words[which[begun]], to_low[begun], to_high[begun])
        found = new_high > new_low
        which = which[found]
        words[which] += 1 << k
        low[which], high[which] = new_low[found], new_high[found]

    def longest_by_document(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the words of its longest match with the block, the item, and the word where it begins."""
        shard, docs = self.shard, len(before) - 1
        best, item, at = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, -1)
        low, high = self.levels[0]
        one = np.flatnonzero(high > low)
        one = one[np.unique(low[one], return_index=True)[1]]
        self._take(before, np.ones(int((high - low)[one].sum()), np.int64), np.repeat(one, (high - low)[one]), _ranges(low[one], high[one]), best, item, at)
        if len(self.levels) == 1:
            return best, item, at
        low, high = self.levels[1]
        two = np.flatnonzero(high > low)
        two = two[np.unique(low[two], return_index=True)[1]]
        places = _ranges(low[two], high[two])
        words, seed, _ = self.longest()
        # a suffix of the shard shares with a benchmark suffix what all suffixes between the two in order share
        link = common_prefixes(shard.codes, shard.order, shard.ranks, int(words.max()))[places].astype(np.int64)
        link[np.cumsum((high - low)[two])[:-1]] = 0
        link[0] = 0
        asked = np.flatnonzero(words > 1)
        asked = asked[np.lexsort((asked, -words[asked], seed[asked]))]
        asked = asked[np.unique(seed[asked], return_index=True)[1]]
        value, who = np.zeros(len(places), np.int64), np.full(len(places), -1)
        spot = np.searchsorted(places, seed[asked])
        value[spot], who[spot] = words[asked], asked
        ahead = _spread(value, who, link)
        back = [x[::-1] for x in _spread(value[::-1], who[::-1], np.r_[0, link[:0:-1]])]
        better = back[0] > ahead[0]
        value, who = np.where(better, back[0], ahead[0]), np.where(better, back[1], ahead[1])
        self._take(before, value, who, places, best, item, at)
        return best, item, at

    def _take(self, before, value, who, places, best, item, at) -> None:
        """Keep, of each document, the longest of some matches (the first of those) if it beats what is there."""
        where = self.shard.position[self.shard.order[places]]
        doc = np.searchsorted(before, where, side="right") - 1
        rank = np.lexsort((where, -value, doc))
        lead = rank[np.r_[True, doc[rank][1:] != doc[rank][:-1]]] if len(rank) else rank
        lead = lead[value[lead] > best[doc[lead]]]
        best[doc[lead]], item[doc[lead]], at[doc[lead]] = value[lead], self.block.item[who[lead]], where[lead] - before[doc[lead]]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur (the number of the word in the shard), and which."""
        low, high = self.windows()
        which = np.repeat(np.arange(len(low)), high - low)
        return self.shard.position[self.shard.order[_ranges(low, high)]], which


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def _spread(value: np.ndarray, who: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of each value and those before it, each no more than the least link on the way, and whose it is.

    Steps double: after each, a place knows the best of twice as many places before it, and the least link
    of as many.
    """
    value, who, link, step = value.copy(), who.copy(), link.copy(), 1
    while step < len(value) and link[step:].any():
        come = np.minimum(value[:-step], link[step:])
        better = np.flatnonzero(come > value[step:])
        come, source = come[better], who[better]
        less = np.minimum(link[step:], link[:-step])
        value[better + step], who[better + step] = come, source
        link[step:] = less
        step *= 2
    return value, who


COLUMNS = "n_words long, n_hit long, items array<string>, longest_match long, longest_item string, longest_at long, hit_spans array<int>"


def _search(sent: Broadcast, further: bool) -> Callable:
    """Search for one block; further: on top of what was found for those before."""

    def start() -> Callable:
        block: Block = sent.value

        def batch(texts: pa.Array, *held: pa.Array) -> list[pa.Array]:
            _, offsets = text_bytes(texts)
            rows = [row for a, z in chunks(offsets, SHARD_BYTES) for row in _found(block, texts.slice(a, z - a))]
            if further:
                rows = [_both(row, old) for row, old in zip(rows, zip(*(h.to_pylist() for h in held)))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]

        return batch

    return start


def _found(block: Block, texts: pa.Array) -> list[tuple]:
    """A row of COLUMNS for each text of a shard."""
    body, offsets = text_bytes(texts)
    hashes, _, _, before = word_hashes(body, offsets)
    docs = len(texts)
    spans: list[list[int]] = [[] for _ in range(docs)]
    items: list[list[str]] = [[] for _ in range(docs)]
    best, which, at = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, -1)
    if len(hashes) and block.items:
        matches = Shard(hashes, before).search(block)
        best, which, at = matches.longest_by_document(before)
        position, window = matches.occurrences()
        order = np.argsort(position, kind="stable")
        position, window = position[order], window[order]
        cuts = np.searchsorted(position, before)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            words, lists = words_of(texts[d].as_py()), set()
            for p, w in zip((position[cuts[d] : cuts[d + 1]] - before[d]).tolist(), window[cuts[d] : cuts[d + 1]].tolist()):
                own = block.windows[w]
                if tuple(words[p : p + len(own)]) != own:  # another word of the same hash
                    continue
                lists.add(int(block.list_of[w]))
                if spans[d] and p <= spans[d][-1]:
                    spans[d][-1] = max(spans[d][-1], p + len(own))
                else:
                    spans[d] += [p, p + len(own)]
            if lists:
                items[d] = sorted(block.items[k] for k in np.unique(np.concatenate([block.lists[x] for x in lists])).tolist())
    return [
        (n, sum(s[1::2]) - sum(s[::2]), i, b, block.items[k] if k >= 0 else None, a, s)
        for n, s, i, b, k, a in zip(np.diff(before).tolist(), spans, items, best.tolist(), which.tolist(), at.tolist())
    ]


def _both(new: tuple, old: tuple) -> tuple:
    """What two blocks have found of a text, put together."""
    spans: list[int] = []
    for a, z in sorted([*zip(new[6][::2], new[6][1::2]), *zip(old[6][::2], old[6][1::2])]):
        if spans and a <= spans[-1]:
            spans[-1] = max(spans[-1], z)
        else:
            spans += [a, z]
    longest = new[3:6] if new[3] > old[3] else old[3:6]
    return (new[0], sum(spans[1::2]) - sum(spans[::2]), sorted([*new[2], *old[2]]), *longest, spans)


def search_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add what each whole document holds of the benchmark.

    n_words: its words. n_hit: those inside an occurrence of a window (10 consecutive words of an item; a
    shorter item is one window). items: ids, as sorted strings, of the items with such windows (repeated
    rows of the benchmark count each; a null id is ""). longest_match: words of the longest verbatim match
    with any item, with longest_item and longest_at (the word of the document where it begins; -1: none).
    hit_spans: first word and word after the last of each stretch of words that are hit, in turn.

    Null and empty texts have no words and no hit, items without words no window. Every row and column
    stays; an empty table or benchmark is fine. Nothing is shuffled, and a lost task is simply run again.

    The benchmark is a stated query set. Its words go to the tasks in blocks of bounded size, and no more
    than one block is on the driver or in a task at a time: where there are several, the documents with what was found so
    far are written to the shared folder between blocks.
    """
    prepare(docs.sparkSession)
    added = [f.split()[0] for f in COLUMNS.split(", ")]
    out, held_at, last = docs, None, None
    for block in blocks_of(benchmark, item_col, item_text_col, window, block_words):
        if last is not None:
            out, at = written(out, "searched")
            last.unpersist()
            if held_at:
                remove(docs.sparkSession, held_at)
            held_at = at
        inputs = [text_col] if last is None else [text_col, *added]
        last, first = docs.sparkSession.sparkContext.broadcast(block), last is None
        out = add_columns(out, inputs, _search(last, not first), COLUMNS)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any hit, as they are."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    names["text_col"] = f"c{columns.index(names.get('text_col', 'text'))}"
    kept = search_benchmark(plain, benchmark, **names).filter("n_hit = 0")
    return kept.select(*plain.columns).toDF(*columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
