"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source, shuffled by a hash, lie end to end on a tape; going round it again gives
repeats. The tape is cut into blocks of equally many words. Slot i of the mix is the golden-ratio point
frac(i / phi) (or the van der Corput point of i), mapped through the cumulative targets to a source; a
source's r-th slot takes the r-th block of its tape. So every stretch of slots has the sources in their
shares, but for the sequence's discrepancy. The schedule decides the order of the mix: which slots a document
is in, and where a written mix has it. A source gives its target of words to the word: slots beyond are
left out, and the few that the schedule leaves open at its end are filled in order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import prepare, remove, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 8192
MOST_REPEATS = 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2 ** 64 / phi
_CHUNK = 8192
_MOST_SOURCES = 1_000_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size (words; null text: 0) mixed, the hash that shuffles documents, and text_hash."""
    # rows without an id are told apart by their texts, so that they don't all fall in one part of the tape
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.xxhash64(text_col, source_col).cast("string"))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.md5(key.cast("binary")).alias("mixed"), F.xxhash64(text_col).alias("text_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """source, source_no, source_size, target: what each source is to give, in words.

    Sources by code point, null last, weigh as weights says, repeating. They share all sizes by weight; a
    target stops at most times its source's size, and the excess is reshared by weight among the others.
    That is one level of words a weight for all sources that don't stop, found over the sources in order of
    when they stop. There is a row a source, so the windows over all of them hold no more than that.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("source_no", number - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    full, past = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_stop.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(full).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * most).over(past), F.lit(0)).alias("stopped"),
        (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(past), F.lit(0))).alias("rest"),
    )
    # if this source is the first that doesn't stop, the level is what is left over the weights left
    level = (F.col("total") - F.col("stopped")) / F.col("rest")
    fits = F.col("source_size") * most >= level * F.col("weight")
    found = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "source_no", level.alias("level")))).over(full)["level"])
    target = F.least((F.col("source_size") * most).cast("double"), F.col("level") * F.col("weight"))
    return found.select("source", "source_no", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def taped(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sizes with source_no, source_size, target, and start: the words before a document on its source's tape.

    A hot source is cut into 4096 parts by the shuffling hash; words are summed within a part, and over
    parts, so no task gets a whole source.
    """
    named = wanted.withColumnRenamed("source", "own")
    rows = sizes.join(F.broadcast(named) if wanted.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rows = rows.withColumn("part", F.substring("mixed", 1, 3))
    parts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_no", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "part").orderBy("mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(parts, ["source_no", "part"]).withColumn("start", F.col("before") + F.col("inner")).drop("part", "before", "inner")


def golden_points(first: int, n: int) -> np.ndarray:
    """frac(i / phi) for i from first, as 64-bit fractions."""
    return np.arange(first, first + n, dtype=np.uint64) * _GOLDEN


def van_der_corput_points(first: int, n: int) -> np.ndarray:
    """The bits of i behind the binary point in reverse order, for i from first, as 64-bit fractions."""
    x = np.arange(first, first + n, dtype=np.uint64)
    for k in range(6):
        width = np.uint64(1 << k)
        mask = np.uint64(sum(((1 << (1 << k)) - 1) << at for at in range(0, 64, 2 << k)))
        x = (x >> width & mask) | (x & mask) << width
    return x


SEQUENCES = {"golden": golden_points, "van_der_corput": van_der_corput_points}


def _edges(quotas: list[int]) -> np.ndarray:
    """Where each source but the first begins, as 64-bit fractions of all quotas."""
    ends, total = list(itertools.accumulate(quotas)), sum(quotas)
    return np.array([min((e << 64) // total, 2**64 - 1) for e in ends[:-1]], np.uint64)


def _counts(edges: np.ndarray, slots: int, points: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                first = chunk * _CHUNK
                found = np.searchsorted(edges, points(first, min(_CHUNK, slots - first)), side="right")
                source, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(source.astype(np.int32)), pa.array(n.astype(np.int64))], ["chunk", "source_no", "n"])

    return run


def _ranks(edges: np.ndarray, slots: int, points: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ahead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = chunk * _CHUNK
                n = min(_CHUNK, slots - first)
                source = np.searchsorted(edges, points(first, n), side="right")
                before = {r["source_no"]: r["before"] for r in ahead}
                order = np.argsort(source, kind="stable")
                own = source[order]
                head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                rank = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n])) + np.array([before[s] for s in own.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(first + order), pa.array(own.astype(np.int32)), pa.array(rank)], ["slot", "source_no", "rank"])

    return run


def schedule(wanted: DataFrame, block_words: int = BLOCK_WORDS, sequence: str = "golden") -> DataFrame:
    """slot, source_no, rank: the source of each slot, and which of its blocks it takes (from 0).

    Slots are ranked by chunks of 8192: counts in each chunk, sums over chunks, ranks within. The targets
    come to the driver, a number a source; more than a million sources are refused.
    """
    spark = wanted.sparkSession
    rows = wanted.orderBy("source_no").select("target").limit(_MOST_SOURCES + 1).toArrow().column(0).to_pylist()
    if len(rows) > _MOST_SOURCES:
        raise ValueError("more than a million sources")
    quotas = [int(t) for t in rows]
    slots = sum(quotas) // block_words
    need = wanted.select("source_no", F.ceil(F.floor("target") / block_words).cast("long").alias("need"))
    if slots:
        edges, points = _edges(quotas), SEQUENCES[sequence]
        chunks = spark.range(0, -(-slots // _CHUNK))
        counts = chunks.mapInArrow(_counts(edges, slots, points), "chunk long, source_no int, n long")
        ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select("chunk", F.struct("source_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")).alias("b"))
        ranks = before.groupBy("chunk").agg(F.collect_list("b").alias("b")).mapInArrow(_ranks(edges, slots, points), "slot long, source_no int, rank long")
        had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
        planned = ranks.join(F.broadcast(need), "source_no").filter("rank < need").drop("need")
        tail = need.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    else:
        planned, tail = None, need.withColumn("had", F.lit(0).cast("long"))
    tail = tail.filter("need > had").select("source_no", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.row_number().over(Window.orderBy("rank", "source_no")) - 1 + slots).cast("long").alias("slot"), "source_no", "rank")
    return tail if planned is None else planned.unionByName(tail)


def mix(tape: DataFrame, wanted: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_REPEATS, sequence: str = "golden") -> DataFrame:
    """The mix itself: slot, source_no, start (of the document on its tape), first_word, n_words, lap.

    A row says that a slot takes n_words words of a document from its first_word on, in which lap of the
    tape. Documents without words have none.
    """
    laps = tape.filter("size > 0").withColumn("quota", F.floor("target")).select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("lap"))
    low = F.col("start") + F.col("lap") * F.col("source_size")
    high = F.least(low + F.col("size"), F.col("quota"))
    laps = laps.withColumns({"low": low, "high": high}).filter("low < high")
    pieces = laps.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))))
    begin = F.greatest("low", F.col("rank") * block_words)
    end = F.least("high", (F.col("rank") + 1) * block_words)
    pieces = pieces.select("source_no", "rank", "start", (begin - F.col("low")).alias("first_word"), (end - begin).alias("n_words"), "lap")
    return pieces.join(schedule(wanted, block_words, sequence), ["source_no", "rank"])


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The tape and the targets of documents. Both are written, as later steps read them more than once."""
    prepare(docs.sparkSession)
    sizes, sizes_at = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    wanted, _ = written(targets(sizes, weights, most), "targets")
    tape, _ = written(taped(sizes, wanted), "tape")
    remove(docs.sparkSession, sizes_at)
    return tape, wanted


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, sequence: str = "golden", **names) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and last_slot of every document.

    taken are the words that the mix takes of it; first_slot and last_slot are where the schedule has the
    first and the last of them (null where none is taken). A null or empty text has size 0 and none is taken
    of it. A null source is a source of its own. Rows that repeat, or share an id, are documents of their
    own. An empty table gives no row; other columns are left out, whatever their names.
    """
    tape, wanted = prepared(docs, **names)
    most = names.get("most", MOST_REPEATS)
    got = mix(tape, wanted, block_words, most, sequence).groupBy("source_no", "start").agg(F.sum("n_words").alias("got"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    out = tape.join(got, ["source_no", "start"], "left")
    some = F.col("size") > 0
    return out.select(
        "doc_id", "size", "source_size", "target", F.when(some, F.coalesce("got", F.lit(0))).otherwise(0).alias("taken"),
        F.when(some, F.col("first")).alias("first_slot"), F.when(some, F.col("last")).alias("last_slot"),
    )


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", sequence: str = "golden", **names) -> DataFrame:
    """The documents of the mix, whole, in the order of its slots: each as often as the mix takes its first word.

    So a source gives its target to within one document. Written as it is, the table's files have the mix in
    order. A document without words goes with the words behind it on the tape. Rows and columns are
    otherwise as they were.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    at = {c: f"c{columns.index(c)}" for c in (id_col, text_col, names.pop("source_col", "source"))}
    of_id, of_text, of_source = at.values()
    tape, wanted = prepared(plain, of_id, of_text, of_source, **names)
    most = names.get("most", MOST_REPEATS)
    # rows that share an id and a text are told apart by their number among those
    same, low_id = Window.partitionBy("row_id", "text_hash"), F.lit(-(2**63))
    laps = tape.withColumn("row_id", F.coalesce("doc_id", low_id)).withColumn("nth", F.row_number().over(same.orderBy("source_no", "start")))
    laps = laps.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("low", F.col("start") + F.col("lap") * F.col("source_size"))
    laps = laps.filter(F.col("low") < F.floor("target")).withColumn("rank", F.floor(F.col("low") / block_words))
    places = laps.join(schedule(wanted, block_words, sequence), ["source_no", "rank"]).select("row_id", "text_hash", "nth", "slot", "low")
    rows = plain.select("*", F.coalesce(F.col(of_id).cast("long"), low_id).alias("row_id"), F.xxhash64(of_text).alias("text_hash"))
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy(F.col(of_source).asc_nulls_last())))
    order = ["slot", "low", "row_id", "text_hash"]
    kept = rows.join(places, ["row_id", "text_hash", "nth"]).repartitionByRange(*order).sortWithinPartitions(*order)
    return kept.select(*plain.columns).toDF(*columns)
