"""Connected components of an edge table by alternating star contraction.

Each round rewires every node to the smallest node it can see (large star), then
every node's smaller neighbours to the smallest of them (small star).  Only
minima are aggregated (map-side combined), so a hub with very many neighbours is
one partial row per task; joins back to the hub are splittable by AQE.  Each
round's edges are written to the shared checkpoint folder, which cuts lineage and
survives lost executors.  Nothing but one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (edges.where(F.col(a) != F.col(b))
            .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())


def _star(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(u, v) with m = the smallest of u and its neighbours."""
    low = edges.groupBy(u).agg(F.least(F.min(v), F.first(u)).alias("m"))
    return edges.join(low, u)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Empty edge table: empty result.  Loops and repeated edges are ignored.
    Raises when ``max_rounds`` is not enough (rounds grow with the logarithm of
    the longest path).
    """
    current = stored(_canonical(edges, a, b))
    mark = None
    for _ in range(max_rounds):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _star(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).union(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        current = stored(small)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if seen == mark:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
