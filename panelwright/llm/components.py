"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_on_hot_key


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: columns ``a`` and ``b`` (long), either order; loops and repeats may occur.
    Returns ``node`` and ``root``. Large-star and small-star steps alternate until no edge
    changes; each step is one aggregation and one equi-join, and each round is cut to the
    shared folder. An empty edge list gives an empty result.

    Nothing but the edge count and a checksum reaches the driver. A star's centre may hold most
    edges: joins go through ``join_on_hot_key``. Raises if ``max_rounds`` rounds don't settle it;
    rounds grow with the logarithm of the nodes.
    """
    held = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(held)
    for _ in range(max_rounds):
        total = 2 * int(before[0])
        both = held.select("a", "b").union(held.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: every larger neighbour of a node hangs on the node's smallest neighbour
        large = (
            join_on_hot_key(both.where("b > a"), low, "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        # small star: every smaller neighbour, and the node itself, hang on the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            join_on_hot_key(large, least, "a", "n", total)
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        held = cut(small)
        after = state(held)
        if after == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
