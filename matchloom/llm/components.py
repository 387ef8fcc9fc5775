"""Connected components of a table of links, by labels that shrink and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written


def components(links: DataFrame) -> DataFrame:
    """node and root of every node that links (columns a and b) name; the root is the smallest of its component.

    In each round every node takes the smallest label among its own and its neighbours', and then that
    label's label. A round's labels are written to the shared folder, which cuts the lineage; only the
    number of changes comes to the driver. Rounds grow with the logarithm of a component's width. A node
    with many links meets only one row a task, as smallest labels are taken before the shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both, both_at = written(both, "links")
    labels, at = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        best = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("root").alias("jump"))
        moved = best.join(jump, "best").select("node", F.least("best", "jump").alias("root"), (F.least("best", "jump") < F.col("root")).alias("moved"))
        new, new_at = written(moved, "labels")
        remove(links.sparkSession, at)
        labels, at = new.drop("moved"), new_at
        if new.filter("moved").limit(1).count() == 0:
            remove(links.sparkSession, both_at)
            return labels
