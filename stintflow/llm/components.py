"""Connected components of a graph that no single machine has to hold.

Large-star and small-star steps in turn: each rewires the neighbours of every node to the smallest one,
until all edges point from a node to the smallest node of its component. Minima are pre-aggregated before
the shuffle and every table of a step is written, so lineage stays short and the joins shuffle both sides
anew, which lets adaptive execution split the hub of a large component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintflow.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return cut_lineage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``u, v``; root is the component's smallest node.

    Loops and repeated edges do no harm; an edge with a null end is dropped. No edges, no rows. A node
    that is its own root is listed as such.
    """
    edges = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = _small_star(_large_star(edges))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
