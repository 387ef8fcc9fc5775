"""Centroid clustering of quantised vectors, each distinct one once and with its weight.

Vectors become whole numbers, and equal ones are grouped with their number. Lloyd's rounds run over the
distinct vectors only: each is assigned to its nearest centroid, and centroids become the floors of weighted means, all in whole
numbers, so that no order of summing matters. At the end the distinct vectors' clusters are joined to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trimmed
from .storage import prepare, remove, written

SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Whole numbers beyond this could not be compared in 64 bits.
_MOST = 2**27
_WIDE = "decimal(38,0)"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """vec_id and q, the floors of 64 times each component; vectors that are not whole are left out."""
    names = vectors.columns
    named = vectors.toDF(*[f"c{k}" for k in range(len(names))])
    identity, vector = (F.col(f"c{names.index(c)}") for c in (id_col, vector_col))
    plain = named.select(identity.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).filter(F.size("v") == size)
    # NaN is above every number, so this leaves it out too; a null component makes forall null
    fits = F.forall("v", lambda x: (x >= -float(_MOST // SCALE)) & (x < float(_MOST // SCALE)))
    return plain.filter(fits).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("q"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector (the smallest of those equally near), and the squared distance."""
    best, at = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for k, centroid in enumerate(centroids):
        apart = vectors - centroid
        distance = np.einsum("ij,ij->i", apart, apart)
        closer = distance < best
        best[closer], at[closer] = distance[closer], k
    return at, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, size)


def _sums(centroids: np.ndarray):
    """For each centroid, the number of vectors of a task that are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            vectors, weight = _matrix(batch.column(0), centroids.shape[1]), batch.column(1).to_numpy()
            at, _ = nearest(vectors, centroids)
            for k in np.unique(at).tolist():
                own = at == k
                count[k] += weight[own].sum()
                total[k] += weight[own] @ vectors[own]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "n": count[some], "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_matrix(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(distance)], ["q", "n", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay."""
    size = centroids.shape[1]
    parts = distinct.select("q", "n").mapInArrow(trimmed(_sums(centroids)), "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j].cast(_WIDE)).alias(f"t{j}") for j in range(size)]).collect()
    new = centroids.copy()
    for row in rows:  # one for each centroid at most
        new[row["cluster"]] = [int(row[f"t{j}"]) // row["n"] for j in range(size)]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid of every vector.

    Vectors with another number of components than size, or with a null, infinite or NaN component, are left
    out, as are those with a component of 2**21 or more either way, whose squared distances need not fit
    64 bits. The first centroids are the vectors with the smallest SHA-256 of "1:" and the id; null ids come last, equal
    ids by their components. Fewer vectors than centroids make fewer centroids; equal vectors may be two centroids, of which the first
    gets all. Each row is a vector of its own; null ids stay. Without vectors there is no row. Other columns are left out, whatever their names.
    An inertia beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    prepare(spark)
    every, _ = written(quantised(vectors, id_col, vector_col, size), "vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = every.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(centroids).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>")
    distinct, distinct_at = written(every.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    now = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        now = moved(distinct, now)
    assigned, _ = written(distinct.mapInArrow(trimmed(_assign(now)), "q array<int>, n long, cluster int, distance long"), "assigned")
    remove(spark, distinct_at)
    part = F.sum(F.col("distance").cast(_WIDE) * F.col("n").cast(_WIDE))
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(part.alias("inertia")).collect()}
    long = lambda x: x if x < 2**63 else None
    total = long(sum(inertia.values()))
    rows = [(k, long(inertia.get(k, 0)), total, c) for k, c in enumerate(now.tolist())]
    # a row for each centroid
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<int>"))
    # a hash is compared first, then the vectors
    with_hash = lambda df: df.withColumn("h", F.xxhash64("q"))
    found = with_hash(every).join(with_hash(assigned.select("q", "cluster", "distance")), ["h", "q"]).select("vec_id", "cluster", "distance")
    return found.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
