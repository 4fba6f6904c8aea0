"""Connected components of an edge table, in rounds of star contraction (large star, small star).

Edges never grow in number beyond one round's two stars; each round is cut with a checkpoint, so a lost executor
costs one round at most. Minima are pre-aggregated before every exchange, and a hub's edges are not exchanged to meet
its minimum: the minima of hubs are broadcast (see ``join_hot``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_hot


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that can be reached.

    Nodes are of any type that has an order, structs included. Self loops and repeated edges do no harm; nodes without an
    edge are not listed; no edges give no rows.
    """
    links = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    told = _state(links)
    for _ in range(most_rounds):
        if not told[0]:
            break
        links = cut_lineage(_small_star(cut_lineage(_large_star(links, told[0])), told[0]))
        now = _state(links)
        if now == told:
            break
        told = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Settled: every link is (node, root).
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    # links hold (larger, smaller): the larger end hangs on the smaller end's least; n counts the links a node is the smaller end of.
    ends = links.select("u", "v", F.lit(0).alias("below")).union(links.select("v", "u", F.lit(1)))
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.sum("below").alias("n")).where("n > 0")
    least = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
    return join_hot(links, least, "v", "n", total).select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(links, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
