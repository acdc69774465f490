"""Connected components of a link table by alternating star contractions; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

MAX_ROUNDS = 60


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest neighbour of that node."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _links(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _links(tied.union(low.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): the smallest node that each linked node reaches. Unlinked nodes get no row.

    Each round is written to the shared folder, so a lost executor costs one round. Ends when a round changes nothing.
    """
    now = materialise(_links(edges), "links")
    stamp = None
    for _ in range(MAX_ROUNDS):
        now = materialise(_small_star(_large_star(now)), "links")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == stamp:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        stamp = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
