"""Ranking and truncation of a subgraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.operators.durable import small
from arcwright.operators.traverse import induced_edges


def external_ids(edges: DataFrame) -> DataFrame:
    """Ids at either end of an external edge, the inner ends among them."""
    return edges.where("is_external").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def rank_keys(project: str | None, collation: str | None = "UNICODE") -> list[Column]:
    """Sort keys over nodes with the flags direct and external; the last breaks all ties."""
    same = X.starts("id", project) if project is not None else F.lit(True)
    last = F.collate(F.col("id"), collation) if collation else F.col("id")
    return [F.desc("direct"), F.desc(same), F.asc("external"), F.asc(X.kind_priority()), F.desc(F.col("doc_comment").isNotNull()), last.asc(), F.asc("id")]


def flagged(nodes: DataFrame, direct: DataFrame, external: DataFrame) -> DataFrame:
    """Nodes with the flags direct and external, by membership of their ids.

    Only external ids among the nodes matter, so those are looked up first.
    """
    mine = external.join(small(nodes.select("id")), "id", "left_semi")
    flags = direct.select("id").distinct().withColumn("__d", F.lit(True)), mine.distinct().withColumn("__e", F.lit(True))
    found = nodes.join(flags[0], "id", "left").join(flags[1], "id", "left")
    return found.withColumn("direct", F.coalesce("__d", F.lit(False))).withColumn("external", F.coalesce("__e", F.lit(False))).drop("__d", "__e")


def rank(nodes: DataFrame, direct: DataFrame, external: DataFrame, project: str | None, collation: str | None = "UNICODE") -> DataFrame:
    """Nodes in order of relevance: direct neighbours, of the project, not external, by kind, documented, by id."""
    return flagged(nodes, direct, external).orderBy(*rank_keys(project, collation)).drop("direct", "external")


def best_ids(nodes: DataFrame, seeds: DataFrame, direct: DataFrame, external: DataFrame, project: str | None, most: int, collation: str | None = "UNICODE") -> DataFrame:
    """Ids of the most relevant nodes, and of all seeds."""
    top = flagged(nodes, direct, external).orderBy(*rank_keys(project, collation)).limit(most).select("id")
    return top.unionByName(seeds.select("id")).distinct()


def first_ids(nodes: DataFrame, reached: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Ids of the nodes nearest to the seeds, ties by load order and id, and of all seeds."""
    order = [F.col("depth"), *([F.col("ord")] if "ord" in nodes.columns else []), F.col("id")]
    top = nodes.join(reached, "id").orderBy(*order).limit(most).select("id")
    return top.unionByName(seeds.select("id")).distinct()


def cut(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the ids and edges between them."""
    return nodes.join(small(ids), "id", "left_semi"), induced_edges(edges, ids)
