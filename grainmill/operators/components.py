"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.lineage import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    others = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.union(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest node.

    Undirected; loops, repeated edges and both directions are allowed, edges
    with a null end are ignored, and a node with no edge but a loop is its own
    component.  Each round contracts all paths at once, so the number of rounds
    grows with the logarithm of the longest path; the edge table never grows and
    is written between rounds.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    looped = pairs.where("x = y").select(F.col("x").alias("node")).distinct()
    state = written(pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    stamp = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
    mark = state.select(stamp).first()[0]
    for _ in range(most_rounds):
        if not mark["n"]:
            break
        state = written(_small_star(_large_star(state)), "edges")
        after = state.select(stamp).first()[0]
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct()
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = looped.join(members, "node", "left_anti").union(roots).distinct()
    return members.union(alone.select("node", F.col("node").alias("component")))
