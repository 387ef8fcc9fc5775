"""Where to cut keys so that their pieces are about equally rare.

A character says as much as it is unexpected after the two before it, or after the one before it at its place in the key, whichever is less; both
are counted over all keys in hashed slots. A key's pieces share out what it says.
Any cut is a right one: what is counted decides how many keys share a piece, not what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of each of the four counts: what is before a character, with and without it, without and with its place.
SLOTS = 1 << 16
#: Characters of a piece; of a longer one, so many are taken.
WIDEST = 16
#: Bits that every character has at least, so that what says nothing is cut as well.
LEAST = 0.02


def _codes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each key begins and ends among the characters of all, and each character's slots (four rows)."""
    words = [w.decode("utf-8", "replace") for w in keys.cast(pa.binary()).to_pylist()]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([0, *map(len, words)])
    place = np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))
    one, two = (np.where(place >= k, np.roll(codes, k) + np.uint64(1), np.uint64(0)) for k in (1, 2))
    own = (codes + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    near, here = (one * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) for x in (two, place))
    slot = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    return ends, np.stack([slot(x) + k * SLOTS for k, x in enumerate((near, near + own, here, here + own))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(4 * SLOTS, np.int64)
    for batch in batches:
        n += np.bincount(_codes(batch.column(0))[1].ravel(), minlength=4 * SLOTS)
    slots = np.flatnonzero(n)
    yield pa.record_batch({"slot": slots.astype(np.int32), "n": n[slots]})


def _cut(bits: np.ndarray, edits: int) -> Callable:
    """Add spots, the place and width of edits + 1 pieces, to keys; found is their first column."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("wide", pa.int32())]))

    def spots(keys: pa.Array) -> pa.Array:
        ends, slots = _codes(keys)
        before, with_it, before_here, with_it_here = bits[slots].astype(np.float64)
        said = np.concatenate([[0.0], np.cumsum(np.maximum(np.minimum(before - with_it, before_here - with_it_here), 0.0) + LEAST)])
        begin, end = ends[:-1], ends[1:]
        edges = [begin]
        for k in range(1, edits + 1):
            goal = said[begin] + (said[end] - said[begin]) * k / (edits + 1)
            at = np.clip(np.searchsorted(said, goal), 1, len(said) - 1)
            at -= goal - said[at - 1] < said[at] - goal
            edges.append(np.minimum(np.maximum(at, edges[-1] + 1), end - (edits + 1 - k)))
        edges.append(end)
        places, widths = [], []
        for first, last in zip(edges, edges[1:]):
            wide = np.minimum(last - first, WIDEST)
            # of a long piece, its head, middle or tail
            among = np.stack([first, (first + last - wide) // 2, last - wide])
            at = among[np.argmax(said[among + wide] - said[among], axis=0), np.arange(len(first))]
            places.append(at - begin)
            widths.append(wide)
        flat = [np.stack(x, axis=1).ravel().astype(np.int32) for x in (places, widths)]
        values = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * (edits + 1)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, spots(batch.column(0))], [*batch.schema.names, "spots"])

    return run


def cuts(keys: DataFrame, edits: int) -> DataFrame:
    """keys, of which found is the first column and m its length, with spots; those of no more characters than edits have no pieces and are left out."""
    counted = keys.filter("m > 0").select("found").mapInArrow(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.ones(4 * SLOTS)
    for slot, of_slot in counted.collect():  # at most 4 * SLOTS rows
        n[slot] = of_slot
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return keys.filter(F.col("m") > edits).mapInArrow(_cut(np.log2(n).astype(np.float32), edits), f"{schema}, spots array<struct<at:int,wide:int>>")
