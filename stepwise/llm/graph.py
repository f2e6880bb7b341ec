"""Connected components of an undirected graph by alternating large-star and small-star steps.

Edges stay distributed; the driver only sees a count and a checksum of each round.  A round joins
every node's neighbours with the node's smallest one; minima are found before the shuffle, and the
neighbours of a node that has very many are split over tasks.  Each round's edges are written, and
those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, hub_join, kept


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or all smaller ones and itself) to their minimum."""
    least = checkpoint(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    linked = hub_join(pairs, least.select("u", "m"), "u", "v", least)
    if large:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return linked.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``): the smallest node that each node of ``edges`` is connected with.

    Loops and repeated edges don't matter; nodes without an edge to another one don't appear.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now, folder = kept(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large, middle = kept(_star(both, True).select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
        spent = [folder, middle]
        now, folder = kept(_star(large, False), "edges")
        for old in spent:
            discard(now.sparkSession, old)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(row)
