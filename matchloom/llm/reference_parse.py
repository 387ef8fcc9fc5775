"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

A window is 13 consecutive words of one document. Every window has an anchor: of its 4-word grams, the
one with the smallest hash (the last of those, if several). Equal windows have equal anchors, so whatever a
window repeats is found where its anchor is. Consecutive windows with one anchor form a segment.

1. Anchors of all documents are counted by document; only those of two documents or more go on.
2. Their segments are read off, each with a 128-bit BLAKE2b digest of its words. Segments of one digest are one kind,
   which belongs to the first document that holds it; all later documents repeat it as a whole.
3. The words of each kind that is not alone with its anchor, cut from its first place, go to reference blocks by anchor. A block is indexed by a
   suffix array of its words, and each of its segments is parsed greedily against what the block holds of earlier
   documents: the longest factor, the longest from there on, and so on. Factors of 13 words or more
   are repeated. A window that straddles the end of a factor may be repeated as well, so these are
   looked up one by one; windows inside a factor need no look.
4. An anchor with more kinds than a block takes has its segments cut into single windows, whose anchor is
   the whole window; such windows meet by their SHA-256.
5. Repeated windows go back to all places of their kind, and each document loses the words that they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trimmed
from .storage import prepare, release, remove, written
from .suffix_dedup import _sliding_min
from .suffixes import suffix_array
from .textbytes import chunks, mixed, text_bytes, word_hashes

WINDOW = 13
GRAM = 4
#: Segments of a reference block.
BLOCK = 8192
_LOW = np.uint64(0xFFFFFFFF)
_LAST = 2**63 - 1


def segments(hashes: np.ndarray, before: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the words of some texts end to end: anchor hash, text, first window in it, number of windows."""
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(before) - window + 1, 0)
    if not count.any():
        return none.astype(np.uint64), none, none, none
    grams = hashes[: len(hashes) - gram + 1]
    for k in range(1, gram):
        grams = mixed(grams * np.uint64(3) + hashes[k : len(hashes) - gram + 1 + k])
    # the hash's upper half, and below it the place, later places first
    key = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    anchor = (_LOW - (_sliding_min(key, window - gram + 1) & _LOW)).astype(np.int64)
    heads = np.cumsum(count) - count
    start = np.arange(int(count.sum())) + np.repeat(before[:-1] - heads, count)
    at = anchor[start]
    new = np.r_[True, at[1:] != at[:-1]]
    new[heads[count > 0]] = True
    first = np.flatnonzero(new)
    begin = start[first]
    text = np.searchsorted(before, begin, side="right") - 1
    return grams[at[first]], text, begin - before[text], np.diff(np.r_[first, len(start)])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of some whole texts at a time: their words, and the rows' other columns."""
    for batch in batches:
        body, offsets = text_bytes(batch.column(2))
        for a, z in chunks(offsets):
            raw = body[offsets[a] : offsets[z]]
            yield raw, word_hashes(raw, offsets[a : z + 1] - offsets[a], spaced=True), batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (hashes, _, _, before), doc, _ in _each(batches):
            anchor, text, _, _ = segments(hashes, before, window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), doc.take(pa.array(text))], ["anchor", "doc"])

    return run


def _digests(raw: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the words begin to end (exclusive) each, joined by one space, as two integers."""
    size = np.concatenate([[0], np.cumsum(last - first)])
    low, high = first[begin], last[end - 1]
    joined = raw.copy()
    joined[(joined >= 9) & (joined <= 13)] = 32
    plain = high - low == size[end] - size[begin] + (end - begin) - 1
    text, out = joined.tobytes(), []
    for a, z, as_is in zip(low.tolist(), high.tolist(), plain.tolist()):
        part = text[a:z]
        out.append(hashlib.blake2b(part if as_is else b" ".join(part.split()), digest_size=16).digest())
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def _read_off(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, (hashes, first, last, before), doc, text_hash in _each(batches):
            anchor, text, at, n = segments(hashes, before, window, gram)
            begin = before[text] + at
            digest = _digests(raw, first, last, begin, begin + n + window - 1)
            where = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), doc.take(where), text_hash.take(where), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "hi", "lo", "doc", "text_hash", "first", "n"],
            )

    return run


_SEGMENT = "anchor long, hi long, lo long, doc long, text_hash long, first int, n int"
_PIECE = "anchor long, hi long, lo long, doc long, hot boolean, body string"
KIND = ["anchor", "hi", "lo"]


def _cut(window: int):
    """From a document's text and its segments, a row for each with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found, bodies = part.column(1), []
                each = found.flatten()
                spans = zip(each.field("first").to_pylist(), each.field("n").to_pylist())
                sizes = found.value_lengths().to_numpy()
                for text, size in zip(part.column(0), sizes.tolist()):
                    words = text.as_py().encode().split()
                    for _ in range(size):
                        first, n = next(spans)
                        bodies.append(b" ".join(words[first : first + n - 1 + window]))
                doc = part.column(2).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([*(each.field(c) for c in KIND), doc, each.field("hot"), pa.array(bodies, pa.binary()).cast(pa.string())], [*KIND, "doc", "hot", "body"])

    return run


class Block:
    """Some pieces of documents, indexed by a suffix array of their words; each is also parsed against it."""

    def __init__(self, bodies: pa.Array, docs: np.ndarray):
        words = pc.split_pattern(bodies, " ")
        sizes = np.diff(words.offsets.to_numpy())
        ids = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 2
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        self.docs = docs
        self.codes = np.ones(int((sizes + 1).sum()), np.int64)  # 1: the end of a piece
        inside = np.ones(len(self.codes), bool)
        inside[self.end] = False
        self.codes[inside] = ids
        width = next(w for w in (3, 2, 1) if int(self.codes.max()) < 1 << (64 // w - 1))
        self.order, _ = suffix_array(self.codes, int(sizes.max()) + 1, width)
        owner = np.repeat(docs, sizes + 1)[self.order]
        # the first document of any stretch of suffixes: minima over powers of two
        self.least = [owner]
        while (step := 1 << (len(self.least) - 1)) * 2 <= len(owner):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
        self.most = np.concatenate([self.codes, [0]])

    def _edge(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray, after: bool) -> np.ndarray:
        """Within each stretch of suffixes that share depth words, the first whose next word is not below word (after: is above it)."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            seen = self.most[np.minimum(self.order[mid] + depth[live], len(self.codes))]
            less = seen <= word[live] if after else seen < word[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return low

    def _extend(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches with one more word, and whether a document below the given one is among them."""
        new = self._edge(low, high, depth, word, False)
        end = self._edge(new, high, depth, word, True)
        some = new < end
        least = np.full(len(new), _LAST)
        level = np.zeros(len(new), np.int64)
        level[some] = np.log2(end[some] - new[some]).astype(np.int64)
        for k in np.unique(level[some]).tolist():
            at = np.flatnonzero(some & (level == k))
            least[at] = np.minimum(self.least[k][new[at]], self.least[k][end[at] - (1 << k)])
        return new, end, some & (least < below)

    def parse(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors: piece, where it begins and its words (0: a word that no earlier document has in the block).

        All pieces are parsed at once, a word a step. A piece's parse ends where no window begins any more.
        """
        piece = np.flatnonzero(self.end - self.begin >= window)
        at = self.begin[piece].copy()
        size, low, high = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64), np.full(len(piece), len(self.codes))
        out: list[tuple[np.ndarray, ...]] = []
        while len(piece):
            inside = at + size < self.end[piece]
            new, end, found = self._extend(low, high, size, np.where(inside, self.most[at + size], 0), self.docs[piece])
            grow = inside & found
            low, high, size = np.where(grow, new, 0), np.where(grow, end, len(self.codes)), np.where(grow, size + 1, size)
            done = np.flatnonzero(~grow)
            if len(done):
                out.append((piece[done], at[done], size[done]))
                at[done] += np.maximum(size[done], 1)
                size[done] = 0
                stay = self.end[piece] - at >= window
                piece, at, size, low, high = piece[stay], at[stay], size[stay], low[stay], high[stay]
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))

    def held(self, piece: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
        """Whether an earlier document has the window that begins at each of these places."""
        out = np.zeros(len(piece), bool)
        live = np.arange(len(piece))
        low, high = np.zeros(len(piece), np.int64), np.full(len(piece), len(self.codes))
        for k in range(window):
            new, end, found = self._extend(low, high, np.full(len(live), k), self.codes[at[live] + k], self.docs[piece[live]])
            live, low, high = live[found], new[found], end[found]
        out[live] = True
        return out

    def repeated(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of repeated windows: piece, first and last window."""
        count = np.maximum(self.end - self.begin - window + 1, 0)
        heads = np.cumsum(count) - count
        mark, ask = np.zeros(int(count.sum()), bool), np.ones(int(count.sum()), bool)
        piece, at, size = self.parse(window)
        number = heads[piece] + at - self.begin[piece]
        ask[number] = False  # the longest factor from there is known
        long = np.flatnonzero(size >= window)
        n = size[long] - window + 1
        inner = np.repeat(number[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        mark[inner], ask[inner] = True, False
        owner = np.repeat(np.arange(len(count)), count)
        asked = np.flatnonzero(ask)
        mark[asked] = self.held(owner[asked], self.begin[owner[asked]] + asked - heads[owner[asked]], window)
        w = np.flatnonzero(mark)
        new = np.r_[True, (np.diff(w) > 1) | (np.diff(owner[w]) > 0)] if len(w) else np.zeros(0, bool)
        first, last = w[new], w[np.r_[new[1:], True]] if len(w) else w
        return owner[first], first - heads[owner[first]], last - heads[owner[first]]


_FOUND = "anchor long, hi long, lo long, low int, high int"


def _parse_block(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        piece, low, high = Block(table.column("body").chunk(0), table.column("doc").to_numpy()).repeated(window)
        kinds = table.select(KIND).take(pa.array(piece))
        return pa.table([*kinds.columns, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], [*KIND, "low", "high"])

    return run


def _single_windows(bodies: DataFrame, window: int) -> DataFrame:
    """Which windows of these segments an earlier document's segment here has, window by window."""
    said = F.split("body", " ")
    one = bodies.select(*KIND, "doc", said.alias("words")).withColumn("low", F.explode(F.sequence(F.lit(0), F.size("words") - window)))
    text = F.array_join(F.slice("words", F.col("low") + 1, F.lit(window)), " ")
    windows, _ = written(one.select(*KIND, "doc", "low", F.sha2(text.cast("binary"), 256).alias("digest")), "windows")
    first, _ = written(windows.groupBy("digest").agg(F.min("doc").alias("least")), "first")
    return windows.join(first, "digest").filter("least < doc").select(*KIND, "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc, text_hash and found: the spans of words (begin, end) that repeated windows cover; they may overlap.

    docs has doc (not null), text_hash and text; the first two tell rows with different texts apart. All segments are
    shuffled once, as digests; words of a segment only once for each kind whose anchor has others.
    """
    spark = docs.sparkSession
    seen = docs.select("doc", "text_hash", "text").mapInArrow(trimmed(_anchors(window, gram)), "anchor long, doc long")
    shared, shared_at = written(seen.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor"), "anchors")
    release(spark)
    every = docs.select("doc", "text_hash", "text").mapInArrow(trimmed(_read_off(window, gram)), _SEGMENT)
    met, met_at = written(every.join(shared, "anchor"), "met")
    remove(spark, shared_at)
    release(spark)
    kinds, kinds_at = written(met.groupBy(*KIND).agg(F.min(F.struct("doc", "text_hash", "first", "n")).alias("at")), "kinds")
    release(spark)
    # written first, so that the join can be split where an anchor has very many kinds
    # a kind that is alone with its anchor shares a window with no other
    many, many_at = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor", (F.col("kinds") > block).alias("hot")), "many")
    fields = F.struct(*KIND, "at.first", "at.n", "hot")
    by_doc = kinds.join(many, "anchor").groupBy(F.col("at.doc").alias("own"), F.col("at.text_hash").alias("own_hash")).agg(F.collect_list(fields).alias("found"))
    wanted, wanted_at = written(by_doc, "wanted")
    release(spark)
    cut = docs.join(wanted, (docs["doc"] == wanted["own"]) & (docs["text_hash"] == wanted["own_hash"])).select("text", "found", "doc")
    # rows that are there many times give their words as often
    pieces = cut.mapInArrow(trimmed(_cut(window)), _PIECE).groupBy(*KIND, "doc", "hot").agg(F.min("body").alias("body"))
    named, named_at = written(pieces, "bodies")
    for path in (wanted_at, many_at):
        remove(spark, path)
    release(spark)
    blocks = max(1, -(-2 * named.count() // block))
    cold = named.filter("not hot").groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")).applyInArrow(_parse_block(window), _FOUND)
    found, found_at = written(cold.unionByName(_single_windows(named.filter("hot"), window)), "found")
    remove(spark, named_at)
    release(spark)

    spans = found.groupBy(*KIND).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    judged, judged_at = written(kinds.join(spans, KIND, "left").select(*KIND, F.col("at.doc").alias("least"), "spans"), "judged")
    whole = F.array(F.struct(F.lit(0).alias("low"), (F.col("n") - 1).alias("high")))
    span = F.explode(F.when(F.col("least") < F.col("doc"), whole).otherwise(F.col("spans")))
    places = met.join(judged, KIND).select("doc", "text_hash", "first", span.alias("span"))
    begin, end = F.col("first") + F.col("span.low"), F.col("first") + F.col("span.high") + window
    covered, covered_at = written(places.select("doc", "text_hash", F.struct(begin.alias("begin"), end.alias("end")).alias("span")), "covered")
    for path in (met_at, kinds_at, found_at, judged_at):
        remove(spark, path)
    release(spark)
    out, _ = written(covered.groupBy("doc", "text_hash").agg(F.collect_list("span").alias("found")), "spans")
    remove(spark, covered_at)
    release(spark)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            size, removed, kept = [], [], []
            for text, found in zip(part.column(1), part.column(2)):
                words = (text.as_py() or "").encode().split()
                size.append(len(words))
                if found.is_valid and len(found):
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, found.values.field(0).to_numpy(), 1)
                    np.add.at(edges, found.values.field(1).to_numpy(), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                removed.append(size[-1] - len(words))
                kept.append(b" ".join(words).decode())
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space) of every document.

    Words are what stands between white space (space, and bytes 9 to 13), unchanged. Each word is removed
    that a window of consecutive words covers which also starts in a document with a smaller id; windows are judged on the
    input. So the first document keeps a passage, and repeats within one document stay.

    A null or empty text has no words, and texts shorter than a window stay. Each row is a document; rows
    that share an id do not remove each other's words. A null id counts as the largest long. An empty
    table gives no row, and other columns are left out, whatever their names.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be 1 to window")
    prepare(docs.sparkSession)
    names = docs.columns
    named = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    place = F.coalesce(doc.cast("long"), F.lit(_LAST)).alias("doc")
    # where rows share ids, a hash of the text tells them apart
    again = named.select(place).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    plain = named.select(doc.cast("long").alias("doc_id"), place, (F.xxhash64(text) if again else F.lit(0).cast("long")).alias("text_hash"), text.alias("text"))
    spans = repeated_spans(plain.filter("text is not null").select("doc", "text_hash", "text"), window, gram, block).withColumnsRenamed({"doc": "own", "text_hash": "own_hash"})
    both = plain.join(spans, (plain["doc"] == spans["own"]) & (plain["text_hash"] == spans["own_hash"]), "left").select("doc_id", "text", "found")
    return both.mapInArrow(trimmed(_remove), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
