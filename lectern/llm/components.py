"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a < b; each b points to its least neighbour, and so do its other smaller neighbours."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): for each end of an edge (a, b) the least id that it is connected with.

    Edges are rows of at most two ids in every step, and no node's neighbours are gathered,
    so a hub is only many rows. Self edges and nulls are ignored. The number of rounds
    grows with the logarithm of the longest chain.
    """
    tidy = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct()
    rows = edges.count()
    now = scratch.keep(tidy, "edges", rows=rows)
    state = None
    while True:
        small = _small_star(_large_star(now).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        after = scratch.keep(small, "edges", rows=rows)
        print_ = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(now)
        now = after
        if tuple(print_) == state:
            break
        state = tuple(print_)
    roots = now.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
