"""Removal of every byte that a 200-byte string found elsewhere covers, by suffix arrays.

Every window of 200 bytes has an anchor: of its 64-byte grams, the one with the smallest hash (the last of
those, if several). Equal windows have their anchors at the same place, so they meet by the anchor's
hash wherever they are. Consecutive windows with one anchor form a segment; a window is in one segment.

1. Segments are read off every document, as hashes. Anchors that occur once are done with.
2. Segments of one 128-bit BLAKE2b digest are of one kind, and so are equal byte for byte. The bytes of a kind are cut
   from its first place; those of a kind with more places are taken twice.
3. These bytes are brought together by anchor into shards. A shard builds a suffix array of its distinct
   stretches (Larsson and Sadakane's refinement), takes common prefixes (Kasai), and windows whose prefix
   of 200 bytes a neighbour shares are repeated, as are those of a stretch that is there twice, byte for
   byte. An anchor with very many kinds goes to several shards; each two of these are merged by binary
   search of one's windows in the other's suffix array.
4. Repeated windows go back to all places of their kind, whose documents' bytes are cut in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trimmed
from .storage import prepare, release, remove, written
from .suffixes import common_prefixes, search, suffix_array
from .textbytes import _CODES, _STEP, chunks, mixed, text_bytes

WINDOW = 200
GRAM = 64
SHARD = 8192
_LOW = np.uint64(0xFFFFFFFF)
_SALT = np.uint64(0xD1B54A32D192ED03)
_ROW = "doc_id long, text_hash long"


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size bytes from each place (size: a power of two), by doubling."""
    h, n = _CODES[body], 1
    while n < size and len(h) > n:
        h = h[:-n] * np.uint64(pow(int(_STEP), n, 1 << 64)) + h[n:]
        n *= 2
    return mixed(h) if n == size else h[:0]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def segments(body: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of some texts end to end: anchor hash, text, first window in it, number of windows."""
    none = np.zeros(0, np.int64)
    grams = gram_hashes(body, gram)
    width = window - gram + 1
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= window)
    if not len(long):
        return none.astype(np.uint64), none, none, none
    # the hash's upper half, and below it the place, later places first
    key = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    anchor = (_LOW - (_sliding_min(key, width) & _LOW)).astype(np.int64)
    count = sizes[long] - window + 1
    heads = np.cumsum(count) - count
    start = np.arange(int(count.sum())) + np.repeat(offsets[:-1][long] - heads, count)
    at = anchor[start]
    new = np.r_[True, (at[1:] != at[:-1])]
    new[heads] = True
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(start)])
    begin, at = start[first], at[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return grams[at], text, begin - offsets[text], n


def _digests(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each stretch of bytes, as two integers."""
    raw = memoryview(np.ascontiguousarray(body))
    out = [hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(begin.tolist(), end.tolist())]
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def _read_off(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(2))
            doc, text_hash = batch.column(0), batch.column(1)
            for a, z in chunks(offsets, 4 << 20):
                low = offsets[a]
                raw, inner = body[low : offsets[z]], offsets[a : z + 1] - low
                anchor, text, first, n = segments(raw, inner, window, gram)
                begin = inner[text] + first
                digest = _digests(raw, begin, begin + n - 1 + window)
                at = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), doc.take(at), text_hash.take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "seg", "seg2", "doc_id", "text_hash", "first", "n"],
                )

    return run


_SEGMENT = "anchor long, seg long, seg2 long, doc_id long, text_hash long, first int, n int"
KIND = ["anchor", "seg", "seg2"]
_CARRIED = [*KIND, "weight", "kinds"]
_PIECE = "anchor long, seg long, seg2 long, weight long, kinds long, body binary"


def _cut(window: int):
    """From a document's text and its segments, a row for each with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows: dict[str, list] = {c: [] for c in (*_CARRIED, "body")}
                for text, found in zip(batch.column(0)[k : k + 256], batch.column(1)[k : k + 256]):
                    raw = text.as_py().encode()
                    for s in found.as_py():
                        for c in _CARRIED:
                            rows[c].append(s[c])
                        rows["body"].append(raw[s["first"] : s["first"] + s["n"] - 1 + window])
                yield pa.RecordBatch.from_pydict(rows, pa.schema([*((c, pa.int64()) for c in _CARRIED), ("body", pa.binary())]))

    return run


class Shard:
    """Some segments' bytes; which of their windows are found twice is asked of its suffix array."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, window: int):
        self.body, self.offsets, self.window = body, offsets, window
        half = 1 << ((window - 1).bit_length() - 1)
        grams = gram_hashes(body, half)
        count = np.maximum(np.diff(offsets) - window + 1, 0)
        self.heads = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(count)), count)
        self.start = np.arange(int(count.sum())) + (offsets[:-1] - self.heads)[self.owner]
        self.key = mixed(grams[self.start] * np.uint64(3) + grams[self.start + window - half]) if len(self.start) else np.zeros(0, np.uint64)

    def stretches(self, wanted: np.ndarray) -> "Stretches":
        return Stretches(self, wanted)


class Stretches:
    """The distinct stretches of consecutive wanted windows, end to end with a 0 behind each, as codes."""

    def __init__(self, shard: Shard, wanted: np.ndarray):
        self.shard, window = shard, shard.window
        self.windows = np.flatnonzero(wanted)
        w = self.windows
        if not len(w):
            self.codes = np.zeros(0, np.int64)
            self.at = np.zeros(0, np.int64)
            self.times = np.zeros(0, np.int64)
            return
        new = np.r_[True, (np.diff(w) > 1) | (np.diff(shard.owner[w]) > 0)]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(w)])
        rel = np.arange(len(w)) - first[run]
        whole = np.add.reduceat(mixed(shard.key[w] + rel.astype(np.uint64) * _SALT), first) ^ n.astype(np.uint64)
        _, lead, same = np.unique(whole, return_index=True, return_inverse=True)
        begin, size = shard.start[w[first]], n + window - 1
        # a run counts as a copy of its lead only if its bytes are the lead's
        total = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(total, size)
        equal = shard.body[np.repeat(begin, size) + inner] == shard.body[np.minimum(np.repeat(begin[lead][same], size) + inner, len(shard.body) - 1)]
        true = np.minimum.reduceat(equal, total) & (n == n[lead][same])
        own = np.where(true, lead[same], np.arange(len(first)))
        kept = np.unique(own)
        sizes = size[kept] + 1
        base = np.cumsum(sizes) - sizes
        self.codes = np.zeros(int(sizes.sum()), np.int64)
        inner = np.arange(len(self.codes)) - np.repeat(base, sizes)
        body = inner < np.repeat(sizes - 1, sizes)
        self.codes[body] = shard.body[(np.repeat(begin[kept], sizes) + inner)[body]].astype(np.int64) + 1
        number = np.searchsorted(kept, own)
        self.at = base[number[run]] + rel  # where each wanted window stands among the codes
        self.times = np.bincount(number, minlength=len(kept))[number[run]]

    def sorted(self) -> np.ndarray:
        return suffix_array(self.codes, len(self.codes) + 1, 7)[0]


def repeated_within(shard: Shard) -> np.ndarray:
    """Whether another window of the shard equals each of its windows."""
    # windows with a hash of their own are left out of the suffix array
    order = np.argsort(shard.key)
    key = shard.key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    wanted = np.zeros(len(key), bool)
    wanted[order] = same[1:] | same[:-1]
    part = shard.stretches(wanted)
    out = np.zeros(len(key), bool)
    if not len(part.codes):
        return out
    suffixes = part.sorted()
    places = np.empty(len(suffixes), np.int64)
    places[suffixes] = np.arange(len(suffixes))
    shared = common_prefixes(part.codes, suffixes, places, shard.window)
    near = np.r_[shared, 0] >= shard.window
    place = places[part.at]
    out[part.windows] = near[place] | near[place + 1] | (part.times > 1)
    return out


def repeated_between(left: Shard, right: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window of the other shard equals each window, by binary search in the other's suffix array."""
    out = []
    for one, other in ((left, right), (right, left)):
        theirs = other.stretches(np.isin(other.key, one.key))
        mine = one.stretches(np.isin(one.key, other.key))
        found = np.zeros(len(one.key), bool)
        if len(theirs.codes) and len(mine.codes):
            suffixes = theirs.sorted()
            at, back = np.unique(mine.at, return_inverse=True)
            hit = np.zeros(len(at), bool)
            for k in range(0, len(at), 4096):
                rows = mine.codes[at[k : k + 4096][:, None] + np.arange(one.window)]
                sizes = np.full(len(rows), one.window)
                hit[k : k + 4096] = search(theirs.codes, suffixes, rows, sizes, True) > search(theirs.codes, suffixes, rows, sizes, False)
            found[mine.windows] = hit[back]
        out.append(found)
    return out[0], out[1]


_FOUND = "anchor long, seg long, seg2 long, low int, high int"


def _search_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        parts = []
        for k in np.unique(side):
            mine = table.filter(pa.array(side == k)).combine_chunks()
            parts.append((mine, Shard(*text_bytes(mine.column("body").chunk(0)), window)))
        if side.min() == 2:
            marks = [repeated_within(parts[0][1])]
        else:
            marks = repeated_between(parts[0][1], parts[1][1]) if len(parts) == 2 else [np.zeros(len(parts[0][1].key), bool)]
        rows = []
        for (mine, shard), mark in zip(parts, marks):
            if len(marks) == 2:  # what is there twice is found in its own shard
                mark &= (mine.column("weight").to_numpy() == 1)[shard.owner]
            w = np.flatnonzero(mark)
            if not len(w):
                continue
            new = np.r_[True, (np.diff(w) > 1) | (np.diff(shard.owner[w]) > 0)]
            first = w[new]
            last = w[np.r_[new[1:], True]]
            own = shard.owner[first]
            at = pa.array(own)
            rows.append(pa.table([*(mine.column(c).take(at) for c in KIND), pa.array((first - shard.heads[own]).astype(np.int32)), pa.array((last - shard.heads[own]).astype(np.int32))], [*KIND, "low", "high"]))
        return pa.concat_tables(rows) if rows else pa.schema([*((c, pa.int64()) for c in KIND), ("low", pa.int32()), ("high", pa.int32())]).empty_table()

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, text_hash, begin, end: spans of bytes that repeated windows cover (they may overlap).

    docs has doc_id, text_hash and text; the first two tell rows with different texts apart. Only digests of segments are
    shuffled for all text, and bytes of one place for each kind whose anchor occurs again.
    """
    spark = docs.sparkSession
    every, every_at = written(docs.select("doc_id", "text_hash", "text").mapInArrow(trimmed(_read_off(window, gram)), _SEGMENT), "segments")
    often, often_at = written(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    met, met_at = written(every.join(often, "anchor"), "met")
    remove(spark, every_at)
    remove(spark, often_at)
    release(spark)
    place = F.struct("doc_id", "text_hash", "first", "n")
    distinct, distinct_at = written(met.groupBy(*KIND).agg(F.count(F.lit(1)).alias("weight"), F.min(place).alias("at")), "distinct")
    # written first, so that the join can be split where an anchor has very many kinds
    many, many_at = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "many")
    asked, asked_at = written(distinct.join(many, "anchor"), "asked")
    remove(spark, distinct_at)
    remove(spark, many_at)

    # bytes of every kind, cut from the first document that has it
    fields = F.struct(*KIND, "at.first", "at.n", "weight", "kinds")
    by_doc = asked.groupBy(F.col("at.doc_id").alias("own"), F.col("at.text_hash").alias("own_hash")).agg(F.collect_list(fields).alias("found"))
    wanted, wanted_at = written(by_doc, "wanted")
    release(spark)
    cut = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["own"]) & (docs["text_hash"] == wanted["own_hash"])).select("text", "found")
    # a row that is there many times gives its bytes as often
    pieces = cut.mapInArrow(trimmed(_cut(window)), _PIECE).groupBy(*KIND, "weight", "kinds").agg(F.min("body").alias("body"))
    bodies, bodies_at = written(pieces, "bodies")
    remove(spark, asked_at)
    remove(spark, wanted_at)
    release(spark)
    shards = max(1, -(-2 * bodies.count() // shard))
    parts = F.ceil(F.col("kinds") / shard)
    copies = F.when(F.col("weight") > 1, F.array("body", "body")).otherwise(F.array("body"))
    placed = bodies.withColumn("body", F.explode(copies)).withColumn("part", F.pmod(F.xxhash64("seg"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select(
        F.when(parts == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor")).alias("shard"), (parts > 1).alias("hot"),
        F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        *KIND, "weight", "body",
    )
    marks, marks_at = written(placed.groupBy("shard", "hot", "p", "q").applyInArrow(_search_shard(window), _FOUND), "marks")
    # written as well, so that the join can be split where a kind has very many places
    found, found_at = written(marks.distinct(), "found")
    remove(spark, bodies_at)
    release(spark)

    begin, end = F.col("first") + F.col("low"), F.col("first") + F.col("high") + window
    spans, _ = written(met.join(found, KIND).select("doc_id", "text_hash", begin.alias("begin"), end.alias("end")), "spans")
    for path in (met_at, marks_at, found_at):
        remove(spark, path)
    release(spark)
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            kept, removed, spans = [], [], []
            for text, found in zip(part.column(1), part.column(2)):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                if not found.is_valid or not len(found):
                    kept.append(raw.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                ends = np.zeros(len(raw) + 1, np.int32)
                np.add.at(ends, found.values.field(0).to_numpy(), 1)
                np.add.at(ends, found.values.field(1).to_numpy(), -1)
                gone = np.cumsum(ends[:-1]) > 0
                kept.append(raw[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            sizes = [len(x) + r for x, r in zip(kept, removed)]
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every document.

    Each byte that a string of window bytes covers which also starts elsewhere (in the same document too)
    is removed; strings are judged on the input. n_spans counts maximal removed runs. A null text is empty,
    texts shorter than the window stay. Each row is a document of its own: repeated rows repeat each
    other's strings. Null ids are fine, an empty table gives no row, and other columns are left out.
    """
    if not 0 < gram < window or gram & (gram - 1) or window < 2 * gram:
        raise ValueError("gram must be a power of two, of half the window at most")
    prepare(docs.sparkSession)
    # where rows share ids, a hash of the text tells them apart
    again = docs.select(F.col(id_col).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    text_hash = F.xxhash64(text_col) if again else F.lit(0).cast("long")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    spans = repeated_spans(plain, window, gram, shard).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("found"))
    spans = spans.withColumnsRenamed({"doc_id": "own", "text_hash": "own_hash"})
    both = plain.join(spans, plain["doc_id"].eqNullSafe(spans["own"]) & (plain["text_hash"] == spans["own_hash"]), "left").select("doc_id", "text", "found")
    return both.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
