"""Ranked lexical search: windows of documents scored term by term into small arrays.

1. One pass over the texts keeps, for each document, its number of terms and how often it holds each term that is
   asked for: a narrow table. Statistics (documents, terms, documents of each term) are sums over it.
2. That table is ranged by doc_id. A task goes through its documents in windows of 8,192 in order of id.
   A window's rows are turned into postings; an item's terms are scattered into an array of scores, which
   fits a processor's cache, and a bitset of occupied places says which to harvest into the item's heap.
3. A task gives its heaps, and the best of all tasks' are kept.

Items go to the tasks in blocks of bounded size, each with its own pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import trimmed
from .storage import prepare, release, remove, scratch, written
from .textbytes import chunks, lower_ascii, text_bytes, word_hashes, words_hashed, words_of

WINDOW = 8192
BEST = 10
#: Words of items that go to the tasks at once (one item at least).
BLOCK_WORDS = 250_000
_B = 75


class Items:
    """A block of items: its distinct terms, and how often each item has each."""

    def __init__(self, rows: list[tuple[int, str]]):
        number: dict[str, int] = {}
        self.items = []
        for item, text in rows:
            counts = Counter(words_of(text))
            if counts:
                self.items.append((item, [(number.setdefault(w, len(number)), n) for w, n in counts.items()]))
        self.terms = list(number)
        self.raw = [w.encode() for w in self.terms]
        hashes = words_hashed(self.terms)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Rows (number, text) of items, in blocks of so many words; only one block is on the driver at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        n = len(words_of(row["text"]))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += n
    if held:
        yield held


def _term_counts(block):
    """Of each text: its number of terms, and the asked terms in it with their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        same = np.zeros(len(asked.hashes) + 1, bool)
        same[1:-1] = asked.hashes[1:] == asked.hashes[:-1]
        if same.any():  # then each word is looked up as it is
            number = {w: k for k, w in enumerate(asked.raw)}
        sizes = np.array([len(w) for w in asked.raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(asked.raw), np.uint8)
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, z in chunks(offsets):
                raw = body[offsets[a] : offsets[z]]
                hashes, first, last, before = word_hashes(raw, offsets[a : z + 1] - offsets[a])
                at = np.minimum(np.searchsorted(asked.hashes, hashes), max(0, len(asked.hashes) - 1))
                hit = np.flatnonzero(asked.hashes[at] == hashes) if len(asked.hashes) else np.zeros(0, np.int64)
                if same.any():
                    term = np.array([number.get(lower_ascii_bytes(raw[x:y]), -1) for x, y in zip(first[hit].tolist(), last[hit].tolist())], np.int64)
                else:
                    term = asked.order[at[hit]]
                    # equal hashes are not yet equal words
                    n = sizes[term]
                    true = n == last[hit] - first[hit]
                    hit, term, n = hit[true], term[true], n[true]
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    left = raw[np.repeat(first[hit], n) + inner]
                    left = np.where((left >= 65) & (left <= 90), left + 32, left)
                    fits = np.logical_and.reduceat(left == every[np.repeat(starts[term], n) + inner], np.cumsum(n) - n) if len(n) else np.zeros(0, bool)
                    term = np.where(fits, term, -1)
                hit, term = hit[term >= 0], term[term >= 0]
                doc = np.searchsorted(before, hit, side="right") - 1
                pair, tf = np.unique(doc * np.int64(len(asked.raw) + 1) + term, return_counts=True)
                doc, term = pair // (len(asked.raw) + 1), pair % (len(asked.raw) + 1)
                edges = pa.array(np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32))
                n = np.diff(before)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tf"],
                )
                yield out.filter(pa.array(n > 0))

    return run


def lower_ascii_bytes(raw: np.ndarray) -> bytes:
    return lower_ascii(raw.tobytes().decode()).encode()


class Heaps:
    """The best documents of each item so far; of equal scores the one that came first stays."""

    def __init__(self, asked: Items, weight: list[int], best: int, length: int, docs: int):
        self.asked, self.weight, self.best, self.length, self.docs = asked, weight, best, length, docs
        self.heaps: list[list[tuple]] = [[] for _ in asked.items]
        self.came = 0

    def window(self, doc_ids: list, n: np.ndarray, edges: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Take in a window of documents: where each one's terms begin and end in terms and tf."""
        size = len(n)
        slot = np.repeat(np.arange(size), np.diff(edges))
        m = 100 - _B + (_B * n * np.int64(self.docs)) // self.length
        by = np.argsort(terms, kind="stable")
        terms, slot, tf = terms[by], slot[by], tf[by]
        impact = np.array(self.weight, np.int64)[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        heads = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        postings = {}
        for t, a, z in zip(terms[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(terms)]):
            held = np.zeros(size, bool)
            held[slot[a:z]] = True
            postings[t] = (slot[a:z], impact[a:z], np.packbits(held))
        scores, bits = np.zeros(size, np.int64), np.zeros(-(-size // 8), np.uint8)
        for heap, (_, wanted) in zip(self.heaps, self.asked.items):
            some = False
            for t, times in wanted:
                if t in postings:
                    at, add, held = postings[t]
                    scores[at] += add if times == 1 else times * add
                    bits |= held
                    some = True
            if some:
                at = np.flatnonzero(np.unpackbits(bits, count=size))
                self._harvest(heap, at, scores[at], doc_ids)
                scores[at] = 0
                bits[:] = 0
        self.came += size

    def _harvest(self, heap: list[tuple], at: np.ndarray, score: np.ndarray, doc_ids: list) -> None:
        over = score > (heap[0][0] if len(heap) == self.best else 0)
        at, score = at[over], score[over]
        if len(at) > self.best:
            least = np.partition(score, len(score) - self.best)[len(score) - self.best]
            above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
            keep = np.sort(np.r_[above, level[: self.best - len(above)]])
            at, score = at[keep], score[keep]
        for k, s in zip(at.tolist(), score.tolist()):
            entry = (s, -(self.came + k), doc_ids[k])
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)


def _search(block, weight: list[int], best: int, length: int, docs: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(block.value, weight, best, length, docs)
        for batch in _windows(batches, window):
            terms, tf = batch.column(2), batch.column(3)
            edges = terms.offsets.to_numpy().astype(np.int64)
            heaps.window(batch.column(0).to_pylist(), batch.column(1).to_numpy(), edges - edges[0], terms.flatten().to_numpy(), tf.flatten().to_numpy())
        rows = [(item, doc, score) for (item, _), heap in zip(heaps.asked.items, heaps.heaps) for score, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return run


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in windows of so many."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, window - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == window:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents, from rank 1.

    Terms are words of ASCII letters (lower-cased), digits and characters beyond ASCII, of whole texts. N documents
    have a term, with L terms in all. A term in df documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1)));
    one of its tf occurrences in a document of n terms scores w * (10**9 tf div (1000 tf + 8 m)), m = 25 + (75 n N div L), and an item
    sums over its terms, repeats included. Scores above 0 count, equal ones by ascending doc_id, null ids last.

    Each row of docs is a document, each row of items an item; rows that share an id stay apart. Null and
    empty texts have no terms, items without terms no rows. Empty tables give no rows. Other columns are
    left out, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = _columns(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")})
    numbered, _ = written(_columns(items, {"item_id": (item_col, None), "text": (item_text_col, "string")}).withColumn("item", F.monotonically_increasing_id()), "items")
    out = scratch(spark, "best")
    for held in blocks(numbered.select("item", "text").filter("text is not null"), block_words):
        asked = Items(held)
        block = spark.sparkContext.broadcast(asked)
        counted, at = written(plain.mapInArrow(trimmed(_term_counts(block)), "doc_id long, n long, terms array<int>, tf array<long>"), "terms")
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        # a row for each term of the block at most
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())
        weight = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(asked.terms))]
        some = counted.withColumn("row", F.monotonically_increasing_id())
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = some.repartitionByRange(parts, F.asc_nulls_last("doc_id"), "row").sortWithinPartitions(F.asc_nulls_last("doc_id"), "row")
        found = ranged.select("doc_id", "n", "terms", "tf").mapInArrow(trimmed(_search(block, weight, best, total["length"] or 1, total["docs"], window)), "item long, doc_id long, score long")
        found.write.mode("append").parquet(out)
        block.unpersist()
        remove(spark, at)
        release(spark)
    schema = "item long, doc_id long, score long"
    spark.createDataFrame([], schema).write.mode("append").parquet(out)  # a table is there even without items
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = spark.read.schema(schema).parquet(out).withColumn("rank", rank).filter(F.col("rank") <= best)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _columns(table: DataFrame, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The first column of each name, under a new name (and as a type)."""
    names = table.columns
    named = table.toDF(*[f"c{k}" for k in range(len(names))])
    columns = {new: F.col(f"c{names.index(old)}") for new, (old, _) in wanted.items()}
    return named.select(*[(c.cast(wanted[new][1]) if wanted[new][1] else c).alias(new) for new, c in columns.items()])
