"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

Shingles are five consecutive words, each with a weight: 1, or how often it stands in the text. A shingle is
a Poisson process of that rate: its arrivals, from a generator seeded by its hash, each fall on one register
of the signature, and a register keeps the shingle with the earliest arrival. A shingle stops as soon as its
next arrival is later than all registers hold. Two signatures agree in a register with the probability
Jaccard similarity of their weighted shingles, which for equal weights is the Jaccard similarity of the sets.
What candidates are searched by is what links are verified by. Documents that agree in all registers of a
band are candidates; a link is verified on all shingles.

Documents with the same weighted shingles are one node from the start. A bucket of candidates is not paired
out: its members are checked against one hub, the member that shares most buckets with others. Of a bucket
that is still in several classes after that, only the members outside its largest class are compared again,
with the members of other classes, in small blocks that are dealt out evenly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import trimmed
from .storage import prepare, remove, written
from .textbytes import chunks, mixed, text_bytes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
_BLOCK = 128
_BINS = 512
_SALT = np.uint64(0xD1B54A32D192ED03)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; their texts and counts.

    A text of fewer words has one shingle, all its words; one without words has itself. Null has none.
    """
    body, offsets = text_bytes(column)
    hashes, _, _, before = word_hashes(body, offsets)
    n, words = len(column), np.diff(before)
    text = np.repeat(np.arange(n), words)
    if len(hashes):
        last = before[1:][text] - np.arange(len(hashes))  # words from each to the end of its text
        key = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            ok = last > k
            at = np.flatnonzero(ok)
            key[at] = mixed(key[at] * np.uint64(3) + hashes[at + k])
        first = np.arange(len(hashes)) == before[:-1][text]
        keep = (last >= size) | (first & (words[text] < size))
        key, text = key[keep], text[keep]
    else:
        key = hashes
    bare = np.flatnonzero((words == 0) & np.array([t.is_valid for t in column], bool))
    if len(bare):
        own = [int.from_bytes(hashlib.blake2b(column[int(k)].as_py().encode(), digest_size=8).digest(), "little") for k in bare]
        key, text = np.concatenate([key, np.array(own, np.uint64)]), np.concatenate([text, bare])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    return key[heads], text[heads], np.diff(np.r_[heads, len(key)])


def signatures(keys: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The ProbMinHash signature of each of n texts with shingles (others have zeros): n rows of registers."""
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    live, time, turn = np.arange(len(keys)), np.zeros(len(keys)), 0
    while len(live):
        turn += 1
        draw = mixed(keys[live] + np.uint64(turn * int(_SALT) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        slot = text[live] * registers + (mixed(draw ^ _SALT) % np.uint64(registers)).astype(np.int64)
        sooner = time < earliest[slot]
        slot, when, who = slot[sooner], time[sooner], keys[live[sooner]]
        np.minimum.at(earliest, slot, when)
        won = earliest[slot] == when
        winner[slot[won]] = who[won]
        go = time < earliest.reshape(n, registers).max(1)[text[live]]
        live, time = live[go], time[go]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mixed(key * np.uint64(3) + signature[:, k])
        out[:, b] = key
    return out.view(np.int64)


def _sign(bands: int, rows: int, size: int, counted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for a, z in chunks(offsets, 8 << 20):
                part = batch.slice(a, z - a)
                keys, text, counts = shingles(part.column(2), size)
                signed = signatures(keys, text, counts.astype(float) if counted else np.ones(len(keys)), z - a, bands * rows)
                own = np.stack([keys, counts.astype(np.uint64)], 1) if counted else keys
                cuts, raw = np.searchsorted(text, np.arange(z - a + 1)) * (16 if counted else 8), own.tobytes()
                node = [hashlib.blake2b(raw[x:y], digest_size=16).digest() if y > x else None for x, y in zip(cuts, cuts[1:])]
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a) * bands + 1, bands, dtype=np.int32)), pa.array(band_keys(signed, bands, rows).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.binary()), found], ["doc_id", "text_hash", "node", "bands"])

    return run


def jaccard(left: pa.Array, right: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of pairs of texts."""
    (a, at, _), (b, bt, _) = shingles(left, size), shingles(right, size)
    n = len(left)
    pair, key = np.concatenate([at, bt]), np.concatenate([a, b])
    order = np.lexsort((key, pair))
    pair, key = pair[order], key[order]
    same = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
    common = np.bincount(pair[1:][same], minlength=n)
    union = np.bincount(at, minlength=n) + np.bincount(bt, minlength=n) - common
    return common / np.maximum(union, 1)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard similarity of shingles a of weights x and b of weights y (both ascending).

    That is the sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). In order of
    x / y, the first of the two is the larger one from i on, the second before it.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    x, y = x.astype(float), y.astype(float)
    order = np.argsort(x[i] / y[j])
    xs, ys = x[i][order], y[j][order]
    below = np.r_[0, np.cumsum(ys)[:-1]]
    above = np.cumsum(xs[::-1])[::-1]
    # shingles of one side alone count with their own weights
    return float((1 / ((above + x.sum() - xs.sum()) / xs + (below + y.sum() - ys.sum()) / ys)).sum()) if len(xs) else 0.0


def similarities(left: pa.Array, right: pa.Array, size: int = SHINGLE, counted: bool = False) -> np.ndarray:
    """The similarity of pairs of texts that a signature estimates."""
    if not counted:
        return jaccard(left, right, size)
    (a, at, x), (b, bt, y) = shingles(left, size), shingles(right, size)
    ends = np.arange(len(left) + 1)
    ac, bc = np.searchsorted(at, ends), np.searchsorted(bt, ends)
    return np.array([probability_jaccard(a[p:q], x[p:q], b[r:s], y[r:s]) for p, q, r, s in zip(ac, ac[1:], bc, bc[1:])], float)


def _verify(least: float, size: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                good = pa.array(similarities(part.column(2), part.column(3), size, counted) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    return run


def linked_in_block(texts: pa.Array, classes: list, asks: list[bool], least: float, size: int, counted: bool = False) -> list[tuple[int, int]]:
    """Links between texts that ask and the others, of different classes, as places.

    Classes that a link joins are not compared again. With weights of 1, a text is first compared with the
    others by sketches: the smallest hash in each of 512 bins. Pairs whose estimate over the bins that either
    fills is more than six standard deviations under the similarity asked for are passed over; of the rest,
    all shingles are compared.
    """
    keys, text, counts = shingles(texts, size)
    n, asking = len(texts), np.array(asks, bool)
    cuts = np.searchsorted(text, np.arange(n + 1))
    sizes = np.diff(cuts)
    sketch = np.full((n, _BINS), 0xFFFFFFFF, np.uint32)
    np.minimum.at(sketch, (text, (keys % np.uint64(_BINS)).astype(np.int64)), (keys >> np.uint64(32)).astype(np.uint32))
    filled = sketch != 0xFFFFFFFF
    names: dict = {}
    group = np.array([names.setdefault(c, len(names)) for c in classes])
    links = []
    for k in np.flatnonzero(asking).tolist():
        far = (group != group[k]) & ~asking
        if not counted:
            far &= (sizes * least <= sizes[k]) & (sizes >= sizes[k] * least)
        others = np.flatnonzero(far)
        if not len(others):
            continue
        bins = np.maximum((filled[others] | filled[k]).sum(1), 1)
        alike = ((sketch[others] == sketch[k]) & filled[k]).sum(1) / bins
        if not counted:
            good = alike >= least - 6 * np.sqrt(least * (1 - least) / bins)
            others, alike = others[good], alike[good]
        mine, own = keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
        for j in others[np.argsort(-alike, kind="stable")].tolist():
            if group[j] == group[k]:
                continue
            theirs = keys[cuts[j] : cuts[j + 1]]
            if counted:
                linked = probability_jaccard(mine, own, theirs, counts[cuts[j] : cuts[j + 1]]) >= least
            else:
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common = int((mine[at] == theirs).sum())
                linked = common >= least * (len(mine) + len(theirs) - common)
            if linked:
                links.append((k, j))
                group[group == group[j]] = group[k]
    return links


def _blocks(least: float, size: int, counted: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes = table.column("node").to_pylist()
        found = linked_in_block(table.column("text").combine_chunks(), table.column("root").to_pylist(), table.column("asks").to_pylist(), least, size, counted)
        return pa.table({"a": pa.array([nodes[k] for k, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weights: str = "one") -> DataFrame:
    """doc_id, text_hash, node and root of every document: documents of one class share a root.

    Two documents are linked if the similarity of their shingles is at least least; classes are the
    connected components of links. With weights "one" it is the Jaccard similarity of the sets of shingles,
    with "count" the probability Jaccard similarity of shingles weighted by how often they stand in a text.
    Documents whose weighted shingles are equal are linked. A document of fewer words has one shingle, all its
    words; one without words has its text, so empty texts are copies of each other. A null text is a class of
    its own (root is null). Every row gives one row: repeated rows, shared and null ids are fine, an empty
    table gives none, and other columns are left out.

    With 28 bands of 5 registers, a pair of similarity 0.8 fails to meet in a bucket with a probability of
    1.5e-5, whatever the texts are; a node's buckets follow from its weighted shingles alone. No bucket, class
    or number of partners is capped. Texts are shuffled once, to bring together those in buckets of two or
    more; these are kept in the shared folder. A bucket of n members that has m outside its largest class after
    the check against its hub takes n * ceil(m / 128) + m * ceil(n / 128) rows of comparison.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    counted = weights == "count"
    prepare(docs.sparkSession)
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        paths.append(path)
        return table

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed, _ = written(plain.mapInArrow(trimmed(_sign(bands, rows, size, counted)), "doc_id long, text_hash long, node binary, bands array<long>"), "signed")
    nodes = signed.filter("node is not null").dropDuplicates(["node"])
    banded = kept(nodes.select("node", F.explode("bands").alias("bucket")), "banded")
    # tables that a join meets by bucket are written first: a join of tables as they are can be split by skew
    full = kept(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "full")
    dense = kept(banded.join(full, "bucket"), "dense")
    central = kept(dense.groupBy("node").agg(F.sum("n").alias("central")), "central")

    ranked = dense.join(central, "node")
    hubs = kept(ranked.groupBy("bucket").agg(F.max(F.struct("central", "node"))["node"].alias("hub")), "hubs")
    pairs = dense.join(hubs, "bucket").filter("node <> hub").select("node", "hub").distinct()

    wanted = nodes.join(central, "node").select("node", "doc_id", "text_hash").withColumnRenamed("doc_id", "own")
    texts = plain.join(wanted, (plain["text_hash"] == wanted["text_hash"]) & plain["doc_id"].eqNullSafe(wanted["own"])).select("node", "text").dropDuplicates(["node"])
    texts = kept(texts, "texts")
    held = pairs.join(texts, "node").withColumnRenamed("text", "near")
    held = held.join(texts.withColumnRenamed("node", "hub"), "hub").select("node", "hub", "near", "text")
    links = kept(held.mapInArrow(trimmed(_verify(least, size, counted)), "a binary, b binary"), "verified")

    # buckets that are still in several classes, each set of members once
    roots = components(links)
    seen = dense.join(roots, "node", "left").select("bucket", "n", "node", F.coalesce("root", "node").alias("root"))
    torn = seen.groupBy("bucket", "n").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
    torn = kept(torn.filter("n > 2 and low <> high").groupBy("n", "members").agg(F.min("bucket").alias("bucket")), "torn")
    of_torn = kept(seen.join(torn.select("bucket"), "bucket"), "of_torn")
    per = of_torn.groupBy("bucket", "n", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = kept(per.groupBy("bucket", "n").agg(F.max(F.struct("size", "root")).alias("top")).select("bucket", F.col("top.root").alias("main"), (F.col("n") - F.col("top.size")).alias("outside")), "largest")
    members = of_torn.join(largest, "bucket").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("asks"), F.ceil(F.col("outside") / _BLOCK).alias("askers"), F.ceil(F.col("n") / _BLOCK).alias("parts"))
    deal = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    asked = members.select("bucket", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("p"), deal(1, "parts").alias("q"), "node", "root", F.lit(False).alias("asks"))
    asking = members.filter("asks").select("bucket", deal(2, "askers").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), "node", "root", "asks")
    more = asked.unionByName(asking).join(texts, "node").groupBy("bucket", "p", "q").applyInArrow(_blocks(least, size, counted), "a binary, b binary")
    more = kept(more, "more")
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    for path in paths:
        remove(docs.sparkSession, path)
    return signed.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))


def classes(found: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of near_duplicates(): the class id is the smallest doc_id of the class."""
    found, _ = written(found.select("doc_id", "root"), "found")
    per, _ = written(found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    out = found.join(per, "root", "left")
    return out.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class: that with the smallest id (of those, the smallest text hash).

    Rows with a null text all stay. Columns and their order are as they were.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    of_id, of_text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    found = near_duplicates(plain, of_id, of_text, **options)
    keepers = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_hash")).alias("k")).select("k.*")
    rows = plain.select("*", F.coalesce(F.col(of_id).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(of_text).alias("text_hash"))
    kept = rows.filter(F.col(of_text).isNotNull()).join(keepers, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    return kept.select(*plain.columns).unionByName(plain.filter(F.col(of_text).isNull())).toDF(*columns)
