"""The keys of an index that are most similar to given keys, from pieces that are cut once.

Similarity is 1 - edits / longer length. An index key within e edits, cut into e + 1 pieces, has one that stands
in the other key unchanged, near its own place. A NearIndex holds the pieces of every key for 0 to 4 edits; a
key is looked up by its own substrings, and what meets is compared as a whole while it streams by.

Where a threshold allows more edits, or as many as a key is long, the distance is deepened: 1, 2, 4, 8, ... edits.
A key is done with at the first distance at which nothing further off can be as similar as the best that was found, so only those still open go
on.

Pieces of equal length can be what most keys share. So with an index too large for broadcast, keys within two edits are looked up first by
pieces that are cut where each says about as much as the others (see pieces.py); only keys that this does not settle are looked up further.

When pieces get shorter than two characters, the keys still open are compared with the index in blocks: a first pass keeps nothing but
each one's best score, a second one the keys that reach it. No pass writes, shuffles or sorts what does not reach the threshold.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..sources.files import remove, shared_path
from . import pieces as rarity

#: Edits for which the pieces are part of the index.
SURE = 4
#: Edits within which keys are looked up by pieces of equal rarity.
CLOSE = 2
#: Rows up to which an index is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Keys of a block, where open keys are compared with all.
BLOCK_ROWS = 50_000
PAIR = ["key", "threshold"]
#: The columns by which the tables of an index are looked up.
LOOKED_UP = {"pieces": ("e", "part"), "rare": ("slot",)}


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table with a broadcast hint if its rows, as counted, allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cut(keys: DataFrame, edits: Column) -> DataFrame:
    """The pieces of keys for some numbers of edits (an array): e, piece, at, part and the key's columns.

    A key of m characters has e + 1 pieces of m div (e + 1) characters; the last ones have one more. Keys of no more than e characters have none.
    """
    rows = keys.withColumn("e", F.explode(edits)).filter("m > e").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("e"))))
    short, longer = F.floor(F.col("m") / (F.col("e") + 1)).cast("int"), F.col("m") % (F.col("e") + 1)
    ahead = F.greatest(F.lit(0), F.col("piece") - (F.col("e") + 1 - longer))
    rows = rows.withColumns({"at": F.col("piece") * short + ahead, "wide": short + (F.col("piece") >= F.col("e") + 1 - longer).cast("int")})
    return rows.withColumn("part", F.substring("found", F.col("at") + 1, F.col("wide"))).drop("wide")


class NearIndex:
    """Keys to compare with, and their pieces.

    index has key, key_ord and tier (lower tiers come first); keys are not empty.
    """

    def __init__(self, index: DataFrame):
        self._take(index.select(F.col("key").alias("found"), F.length("key").alias("m"), "key_ord", F.col("tier").cast("int").alias("tier")))

    def _take(self, keys: DataFrame) -> NearIndex:
        self.keys, self.pieces = keys, cut(keys, F.sequence(F.lit(0), F.lit(SURE)))
        self._sizes: tuple | None = None
        self._rare: DataFrame | None = None
        return self

    def rare(self) -> DataFrame:
        """Keys with the slots of their pieces for CLOSE edits, cut by rarity, which is counted once, over all keys."""
        if self._rare is None:
            self._rare = _rare(self.keys, rarity.cuts(self.keys, CLOSE))
        return self._rare

    def large(self) -> bool:
        """Whether its pieces are too many to be sent to all tasks."""
        return self.sizes()[3] > BROADCAST_ROWS

    def sizes(self) -> tuple[int, int, int, int, tuple[int, ...]]:
        """Keys, length of the shortest and of the longest, pieces, and tiers; counted once."""
        if self._sizes is None:
            pieces = F.sum(F.aggregate(F.sequence(F.lit(0), F.least(F.lit(SURE), F.col("m") - 1)), F.lit(0), lambda n, e: n + e + 1))
            row = self.keys.filter("m > 0").agg(F.count(F.lit(1)), F.min("m"), F.max("m"), pieces, F.array_sort(F.collect_set("tier"))).first()
            self._sizes = (row[0], row[1] or 0, -1 if row[2] is None else row[2], row[3] or 0, tuple(row[4]))
        return self._sizes

    def save(self, path: str, buckets: int | None = 64) -> None:
        """Write the index to a folder. Its pieces are bucketed and sorted as they are looked up, so that no lookup shuffles them.

        Without buckets (for an index small enough to be sent to all tasks) they are plain files.
        """
        spark = self.keys.sparkSession
        self.keys.write.parquet(f"{path}/keys")
        # what was written is read again, so that keys are derived once
        again = NearIndex.__new__(NearIndex)._take(spark.read.schema(self.keys.schema).parquet(f"{path}/keys"))
        self._sizes = again.sizes()
        about = {"buckets": buckets, "sizes": self.sizes(), "rare": buckets is not None and self.large()}
        if buckets is None:
            again.pieces.write.parquet(f"{path}/pieces")
        else:
            tables = {"pieces": again.pieces} | ({"rare": again.rare()} if about["rare"] else {})
            for kind, table in tables.items():
                name, by = _table(f"{path}/{kind}"), LOOKED_UP[kind]
                spark.sql(f"DROP TABLE IF EXISTS {name}")
                try:
                    table.repartition(buckets, *by).write.option("path", f"{path}/{kind}").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
                finally:
                    spark.sql(f"DROP TABLE IF EXISTS {name}")  # of an external table, the files stay
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NearIndex:
        """An index that save() has written."""
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        out = cls.__new__(cls)
        out.keys, out._rare = spark.read.parquet(f"{path}/keys"), None

        def stored(kind: str, like: DataFrame) -> DataFrame:
            name, columns, by = _table(f"{path}/{kind}"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema), ", ".join(LOOKED_UP[kind])
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{path}/{kind}'")
            return spark.table(name)

        if about["buckets"] is None:
            out.pieces = spark.read.parquet(f"{path}/pieces")
        else:
            out.pieces = stored("pieces", cut(out.keys, F.sequence(F.lit(0), F.lit(SURE))))
        if about.get("rare"):
            out._rare = stored("rare", _rare(out.keys, out.keys.withColumn("spots", F.array().cast("array<struct<at:int,wide:int>>"))))
        out._sizes = (*about["sizes"][:4], tuple(about["sizes"][4]))
        return out

    def persist(self) -> NearIndex:
        self.keys.persist()
        self.pieces.persist()
        return self

    def unpersist(self) -> None:
        self.keys.unpersist()
        self.pieces.unpersist()


def _letters(text: Column) -> Column:
    """A bit for each letter that a text has. An edit changes two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(37)))
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(bit(c)))


def _rare(keys: DataFrame, spotted: DataFrame) -> DataFrame:
    """found, m, key_ord, tier, letters and slot: the pieces of keys at their spots, in every place where another key can have them.

    A piece has at most as many edits before it as its number, or no more behind it than are left. The fewer of both bound its
    place, from the beginning (0 and up) or from the end (below 0). Equal slots are no proof; keys are compared as a whole.
    """
    at, piece = F.col("spot.at"), F.col("piece")
    rows = spotted.withColumn("letters", _letters(F.col("found"))).select(*keys.columns, "letters", F.posexplode("spots").alias("piece", "spot"))
    front, far = piece <= CLOSE - piece, F.least(piece, CLOSE - piece)
    place = F.when(front, at).otherwise(at - F.col("m"))
    rows = rows.withColumn("part", F.expr("substring(found, spot.at + 1, spot.wide)")).withColumn("front", front).withColumn("place", F.explode(F.sequence(place - far, place + far)))
    return rows.filter((F.col("place") >= 0) == F.col("front")).select(*keys.columns, "letters", F.xxhash64("part", "place").alias("slot"))


def _table(path: str) -> str:
    return f"near_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def _edits(longer: Column, t: Column) -> Column:
    """The edits within which a similarity of t is in reach, if the longer key has so many characters."""
    return F.when(t > 0, F.least(longer, F.floor(longer * (1 - t) + 1e-9).cast("int"))).otherwise(longer)


def _banded(pairs: DataFrame, least: int, longest: int) -> DataFrame:
    """Pairs that can reach their threshold, with n, the lengths low to high that can, and the most edits; deep where the index's pieces are not enough.

    Lengths are worked out in doubles and cut off before they become whole numbers, so that any threshold will do.
    """
    n, t = F.length("key"), F.col("threshold")
    able = pairs.select(*PAIR, n.alias("n")).filter(~F.isnan(t) & (t <= 1))
    n = F.col("n")
    low = F.when(t > 0, F.greatest(F.lit(least), F.ceil(n * t).cast("int") - 1)).otherwise(F.lit(least))
    high = F.when(t > 0, F.least(F.lit(float(longest)), n / F.nullif(t, F.lit(0.0)) + 1).cast("int")).otherwise(F.lit(longest))
    able = able.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("most", _edits(F.greatest("n", "high"), t))
    shortest = _edits(F.greatest("n", "low"), t) >= F.col("low")
    return able.withColumn("deep", (F.col("most") > SURE) | shortest)


def may_be_deep(rows: DataFrame, key: Column, threshold: Column, index: NearIndex) -> bool:
    """Whether a row of a table needs more than the index's pieces: one pass over the rows, which ends at the first."""
    rows_, least, longest, *_ = index.sizes()
    if not rows_:
        return False
    asked = rows.select(key.alias("key"), threshold.alias("threshold")).filter("key is not null")
    return bool(_banded(asked, least, longest).filter("deep").limit(1).count())


def _probed(asked: DataFrame, pieces: DataFrame, pieces_rows: int, own: bool) -> DataFrame:
    """The keys that share a piece with a pair and reach its threshold: key, threshold, tier, score, found, key_ord; some more than once.

    asked has key, threshold, n, low, high and e, the number of edits whose pieces are looked up. own: only
    lengths of which e is the very reach; otherwise all keys within e edits. A piece can be chosen so that
    at most as many edits are before it as its number, and no more behind it than are left, which bounds its place.
    """
    e, n = F.col("e"), F.col("n")
    shortest, longest = F.greatest(F.col("low"), n - e, F.lit(1)), F.least(F.col("high"), n + e)
    narrow = F.greatest(F.lit(1), F.floor(shortest / (e + 1)).cast("int"))
    broad = F.least(n, F.floor(longest / (e + 1)).cast("int") + 1)
    probes = _substrings(asked.filter((shortest <= longest) & (narrow <= broad)), narrow, broad).withColumnRenamed("e", "edits")
    e, m = F.col("edits"), F.col("m")
    longer, reach = n - m, _edits(F.greatest(n, m), F.col("threshold"))
    first = F.greatest(F.col("at") - F.col("piece"), F.col("at") + longer - (e - F.col("piece")))
    last = F.least(F.col("at") + F.col("piece"), F.col("at") + longer + (e - F.col("piece")))
    same = (e == F.col("e")) & (F.col("said") == F.col("part"))
    near = same & m.between(F.col("low"), F.col("high")) & (F.abs(longer) <= e) & F.col("start").between(first, last) & ((reach == e) if own else F.lit(True))
    return _compared(probes.join(small(pieces, pieces_rows), near), F.least(e, reach))


def _substrings(asked: DataFrame, narrow: Column, broad: Column) -> DataFrame:
    """said and start: all substrings of keys that are narrow to broad characters wide."""
    probes = asked.withColumn("wide", F.explode(F.sequence(narrow, broad)))
    return probes.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("wide")))).withColumn("said", F.substring("key", F.col("start") + 1, F.col("wide")))


def _compared(met: DataFrame, edits: Column) -> DataFrame:
    return _scored(met.withColumn("distance", F.call_function("levenshtein", F.col("key"), F.col("found"), edits)).filter("distance >= 0"))


def _scored(met: DataFrame) -> DataFrame:
    scored = met.withColumn("score", similarity(F.col("key"), F.col("found"), F.col("distance"))).filter("score >= threshold")
    return scored.select(*PAIR, "tier", "score", "found", "key_ord")


def near_keys(pairs: DataFrame, index: NearIndex, deep: bool | None = None) -> DataFrame:
    """key, threshold, tier, found, key_ord, score: the index keys most similar to each key, ties kept.

    pairs are distinct (key, threshold). The lowest tier that has a key at the threshold decides. Any
    threshold will do: nothing reaches NaN or what is above 1, and everything 0 or less. deep: what may_be_deep()
    said; unless it said no, the pairs that need it are deepened at once, with a few jobs for each distance.
    """
    rows, least, longest, pieces, tiers = index.sizes()
    bands, close = _banded(pairs, least, longest), None
    if index.large():
        scratch = None if deep is False else _Scratch(pairs.sparkSession)
        close, bands = _close(bands, index, tiers, scratch)
        if scratch is not None and not bands.limit(1).count():
            return close
    found = _beyond(bands, index, deep)
    return found if close is None else close.unionByName(found)


def _close(bands: DataFrame, index: NearIndex, tiers: tuple[int, ...], scratch: _Scratch | None) -> tuple[DataFrame, DataFrame]:
    """What near_keys gives for pairs that keys within CLOSE edits settle, and the bands of the others.

    A pair is settled if its threshold allows no more edits, or if its best key is of the lowest tier and nothing further off can be as similar.
    Without scratch nothing runs at once.
    """
    keep = (lambda df, *_: df) if scratch is None else scratch.write
    bands = keep(bands, "bands", True)
    # all keys that can reach the threshold have pieces
    able = bands.filter(F.col("low") > CLOSE).select(*PAIR, "n", "low", "high", _letters(F.col("key")).alias("has"))
    probes = _substrings(able, F.lit(1), F.least("n", F.lit(rarity.WIDEST))).withColumn("place", F.explode(F.array(F.col("start"), F.col("start") - F.col("n"))))
    probes = probes.select(*able.columns, F.xxhash64("said", "place").alias("said"))
    n, m = F.col("n"), F.col("m")
    edits = F.least(F.lit(CLOSE), _edits(F.greatest(n, m), F.col("threshold")))
    near = (F.abs(n - m) <= edits) & (F.bit_count(F.col("has").bitwiseXOR(F.col("letters"))) <= 2 * edits) & m.between(F.col("low"), F.col("high"))
    # substrings are more than Spark expects of exploded rows, and never to be sent to all tasks
    met = probes.hint("merge").join(index.rare(), (F.col("said") == F.col("slot")) & near)
    best = F.rank().over(Window.partitionBy(*PAIR).orderBy("tier", F.desc("score")))
    hits = keep(_compared(met, edits).distinct().withColumn("best", best).filter("best = 1").drop("best"), "close", True)
    further = 1.0 - F.lit(CLOSE + 1.0) / (F.col("n") + CLOSE + 1)
    whole = (F.col("low") > CLOSE) & (F.col("most") <= CLOSE)
    settled = whole | ((F.col("tier") == tiers[0]) & (F.col("score") > further))
    found = hits.join(bands.select(*PAIR, "n", "low", "most"), PAIR).filter(settled).select(*hits.columns)
    return found, keep(bands.filter(~whole).join(found.select(*PAIR).distinct(), PAIR, "left_anti"), "open", True)


def _beyond(bands: DataFrame, index: NearIndex, deep: bool | None) -> DataFrame:
    """What near_keys gives, by the pieces of equal length and, unless deep says no, by deepening."""
    rows, _, _, pieces, tiers = index.sizes()
    fewest = _edits(F.col("n"), F.col("threshold"))
    asked = bands.filter("not deep").withColumn("e", F.explode(F.sequence(fewest, F.greatest(fewest, F.col("most")))))
    # equal scores are equal doubles: a quotient of whole numbers is rounded one way
    best = F.rank().over(Window.partitionBy(*PAIR).orderBy("tier", F.desc("score")))
    found = _probed(asked, index.pieces, pieces, True).distinct().withColumn("best", best).filter("best = 1").drop("best")
    if deep is False or not rows:
        return found
    return found.unionByName(_deepened(bands.filter("deep"), index, tiers))


class _Scratch:
    """Tables of the shared folder, which cut their lineage; gone with clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = shared_path(self.spark, name)
        if not keep:
            self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)


def _deepened(pairs: DataFrame, index: NearIndex, tiers: tuple[int, ...]) -> DataFrame:
    """What near_keys gives, for pairs with any threshold; tier by tier, a distance at a time."""
    scratch = _Scratch(pairs.sparkSession)
    left, out = scratch.write(pairs.select(*PAIR, "n", "low", "high", "most"), "asked"), []
    rows, _, longest, pieces, _ = index.sizes()
    for tier in tiers:
        keys, rest, edits = index.keys.filter(F.col("tier") == tier), left, 1
        done: list[DataFrame] = []
        while edits <= longest:
            # all keys within so many edits have pieces of two characters or more, if the pair is this long
            able = rest.filter((F.col("n") >= 3 * edits + 2) & (2 * F.col("most") > F.lit(edits)))
            if not able.limit(1).count():
                break
            held = index.pieces.filter((F.col("tier") == tier) & (F.col("e") == edits)) if edits <= SURE else cut(keys, F.array(F.lit(edits)))
            met = _probed(able.withColumn("e", F.lit(edits)), held, pieces if edits <= SURE else rows * (edits + 1), False)
            hits = scratch.write(met.distinct(), "hits")
            best = hits.groupBy(*PAIR).agg(F.max("score").alias("best"))
            # nothing further off is as similar: one more edit than were looked at, in the longest key that has it
            further = 1.0 - F.lit(edits + 1.0) / (F.col("n") + edits + 1)
            over = F.coalesce(F.col("best") > further, F.lit(False)) | (F.col("most") <= edits)
            judged = scratch.write(able.join(best, PAIR, "left").filter(over).select(*PAIR, "best"), "judged")
            done.append(hits.join(judged.filter("best is not null"), PAIR).filter("score = best").drop("best"))
            rest = scratch.write(rest.join(judged.select(*PAIR), PAIR, "left_anti"), "open")
            edits *= 2
        done.append(_in_blocks(rest, keys, rows, scratch))
        found = scratch.write(reduce(DataFrame.unionByName, done), "found", keep=True)
        out.append(found)
        left = scratch.write(left.join(found.select(*PAIR).distinct(), PAIR, "left_anti"), "left")
    scratch.clear()
    return reduce(DataFrame.unionByName, out)


def _in_blocks(pairs: DataFrame, keys: DataFrame, rows: int, scratch: _Scratch) -> DataFrame:
    """The best keys of pairs among all keys, block by block; only best scores are gathered, and then the keys that have them."""
    blocks = max(1, -(-rows // BLOCK_ROWS))
    dealt = keys.withColumn("block", F.pmod(F.xxhash64("found"), F.lit(blocks)).cast("int"))
    asked = pairs.withColumn("of_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n, m = F.col("n"), F.col("m")

    def compared(asked: DataFrame, least: Column) -> DataFrame:
        reach = _edits(F.greatest(n, m), least)
        near = (F.col("block") == F.col("of_block")) & m.between(F.col("low"), F.col("high")) & (F.abs(n - m) <= reach)
        met = asked.join(small(dealt, rows), near)
        return met.withColumn("distance", F.call_function("levenshtein", F.col("key"), F.col("found"), reach)).filter("distance >= 0")

    best = scratch.write(_scored(compared(asked, F.col("threshold"))).groupBy(*PAIR).agg(F.max("score").alias("best")), "best")
    again = compared(asked.join(best, PAIR), F.col("best")).withColumn("score", similarity(F.col("key"), F.col("found"), F.col("distance")))
    return again.filter("score = best").select(*PAIR, "tier", "score", "found", "key_ord")
