"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import stage


def _digest(edges: DataFrame) -> tuple:
    whole = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(whole, F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has a link: columns ``node`` and ``root``.

    ``edges`` has two columns ``a`` and ``b`` of non-null numbers; direction, repeats and
    loops do not matter. A large-star step links the larger neighbours of every node to
    its smallest one, a small-star step the smaller ones; in turn they end with stars
    after a few rounds. Neighbours are never listed per node: each step is a minimum per
    node, combined before its shuffle, and a join with one row per node on one side.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links",
    )
    seen = _digest(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large-star")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lower.select("a", F.col("m").alias("b")),
        ).distinct()
        current = stage(small, "small-star")
        now = _digest(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
