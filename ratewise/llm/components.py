"""Connected components of an edge table, as Spark joins and minima.

Alternates the large-star and small-star steps: every round replaces each
node's links by links to its smallest neighbour, so paths shorten fast and the
number of edges does not grow. Each round is written to the shared folder.
Nothing but two counters comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import cut_lineage

MAX_ROUNDS = 60


def _smallest(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return (edges.select(F.col("v").alias("u"), F.col("u").alias("v"))      # v > u
            .join(least, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours, and itself, to the smallest of them."""
    least = _smallest(edges)
    moved = (edges.join(least, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id that an edge joins to another; root is the
    smallest id of its component. Self-loops, repeated edges and edges with a
    null end are ignored. An empty table gives an empty result."""
    now = cut_lineage(edges.where(F.col(a) != F.col(b))
                      .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        now = cut_lineage(_small_star(_large_star(now).distinct()).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
