"""Connected components by alternating star contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import durable


def _settled(links: DataFrame) -> bool:
    """Whether the links (u, v) are stars: no node hangs on two others, and none that hangs has others hanging on it."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("on"), F.min("hangs").alias("below"))
    return nodes.where("on > 1 or (on = 1 and below = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v); root is the least node that can be reached.

    Each round hangs every larger neighbour onto a node's least neighbour, then every smaller one, until only stars are
    left. Both steps are a grouped minimum (combined before the shuffle) and one equi-join of two written tables, which
    is dealt by their real sizes and split at run time where a node has very many links; no node's links are gathered.
    The number of rounds grows with the logarithm of the longest path. Loops (u = u) and rows with a null end give no
    links; a node that stands only in a loop is its own root. No edges give no rows. Repeated edges count once.
    """
    given = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    all_ = durable(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = all_.where("u > v")
    for _ in range(rounds):
        if _settled(links):
            break
        # Larger neighbours onto the least of the neighbourhood.
        both = links.union(links.select("v", "u"))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        links = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Smaller neighbours (and the node itself) onto the least.
        least = durable(links.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        links = durable(links.join(least, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    alone = all_.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return found.union(alone.join(found, "node", "left_anti"))
