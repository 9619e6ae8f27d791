"""Bounded search in both directions, and the subgraph that a set of nodes induces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.operators.durable import keep, small


def adjacency(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """(src, dst) of every edge, both ways, from one scan; external edges only if asked for."""
    if not include_external:
        edges = edges.where(~F.col("is_external"))
    ways = F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))
    return edges.select(F.explode(ways).alias("e")).select("e.src", "e.dst")


def traverse(seeds: DataFrame, edges: DataFrame, depth: int, include_external: bool = False) -> DataFrame:
    """(id, depth) of all ids within so many hops of the seeds' ids; seeds are at 0.

    Ids count, not nodes: those that no node has are reached and walked through too. Every hop's
    frontier is kept, so that plans don't grow, and broadcast while it is small; the edges then are
    only scanned. Larger frontiers are joined by shuffle.
    """
    reached = keep(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = reached
    ways = adjacency(edges, include_external)
    for hop in range(1, depth + 1):
        near = small(frontier.select(F.col("id").alias("src")))
        step = ways.join(near, "src").select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(reached, "id", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def direct_neighbours(reached: DataFrame) -> DataFrame:
    """Ids at most one hop away, seeds among them."""
    return reached.where("depth <= 1").select("id")


def induced_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the ids; ids without a node vanish."""
    return nodes.join(small(ids.select("id")), "id", "left_semi")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends are among the ids, whether nodes or not."""
    a, b = (small(ids.select(F.col("id").alias(c))) for c in ("from_id", "to_id"))
    return edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi").select(edges.columns)
