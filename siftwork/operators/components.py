"""Connected components of an edge table (transitive closure of a symmetric relation).

Alternates two star contractions: the large star links every larger neighbour of a node to the node's smallest
neighbour, the small star links a node and its smaller neighbours to the smallest of them. The edges shrink to stars
whose centres are the components' smallest ids, in a logarithmic number of rounds even on long chains. Each round is
cut by a written table; nothing but the test for the end reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut, drop


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges (u, v), v < u, are stars: every u stands once and is no star's centre."""
    ends = edges.select("u", F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
    return ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("centre").alias("centre")).filter("child + centre > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """edges(u, v), any direction, self-loops and repeats allowed, nulls ignored -> (id, component), one row for each id on an
    edge to another; component is the smallest id that can be reached."""
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct()
    edges = cut(_small_star(edges), "components")
    for _ in range(max_rounds):
        if _is_done(edges):
            break
        before, edges = edges, cut(_small_star(_large_star(edges)), "components")
        drop(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
