"""Counts, facets, and the sample of a graph that a page can show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.model import Graph
from arcwright.operators.durable import keep, small
from arcwright.operators.traverse import induced_edges


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, type_count, method_count (constructors among the methods)."""
    n = nodes.agg(F.count("*").alias("node_count"), F.count_if(F.col("kind") == "type").alias("type_count"), F.count_if(F.col("kind").isin("method", "constructor")).alias("method_count"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count"))).select("node_count", "edge_count", "type_count", "method_count")


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree) of every end of an edge, or those among ids; parallel edges count each, loops twice."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return counted if ids is None else counted.join(ids, "id", "left_semi")


def kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def assemblies(nodes: DataFrame) -> DataFrame:
    """(assembly_name, n), the largest first; nodes without an assembly don't count."""
    return nodes.where("assembly_name <> ''").groupBy("assembly_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "assembly_name")


def sample(graph: Graph, most: int) -> Graph:
    """At most so many nodes and the edges between them.

    A graph that is small enough stays whole, with edges that lead nowhere. Types and namespaces come
    first; if they don't fit, the first nodes in load order are taken instead. Otherwise the rest goes
    to other nodes, those of most edges first, ties in load order.
    """
    if graph.nodes.count() <= most:
        return graph
    always = graph.nodes.where(F.col("kind").isin("type", "namespace"))
    room = most - always.count()
    if room <= 0:
        nodes = graph.nodes.orderBy("ord", "id").limit(most)
    else:
        rest = graph.nodes.where(~F.col("kind").isin("type", "namespace"))
        ranked = rest.join(degrees(graph.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        top = ranked.orderBy(F.desc("degree"), "ord", "id").limit(room).drop("degree")
        nodes = always.unionByName(top.select(always.columns))
    nodes = keep(nodes)
    return Graph(nodes, induced_edges(graph.edges, nodes), graph.meta)


def visible_nodes(nodes: DataFrame, kinds: list[str] | None = None, assembly: str | None = None, search: str | None = None) -> DataFrame:
    """Nodes of some kinds, of an assembly, whose name or id holds a text."""
    if kinds is not None:
        nodes = nodes.where(F.col("kind").isin(kinds))
    if assembly:
        nodes = nodes.where(F.col("assembly_name") == assembly)
    if search:
        nodes = nodes.where(X.contains("name", search) | X.contains("id", search))
    return nodes


def visible_links(edges: DataFrame, nodes: DataFrame, visible: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges of some types of which neither end is a node that is hidden; ends without a node don't matter."""
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    hidden = keep(nodes.select("id").join(visible.select("id"), "id", "left_anti"))
    for end in ("from_id", "to_id"):
        edges = edges.join(small(hidden.select(F.col("id").alias(end))), end, "left_anti")
    return edges


def view_nodes(nodes: DataFrame) -> DataFrame:
    """The nine columns that a page needs of a node."""
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100)).alias(c)
    return nodes.select("id", "name", cap("kind"), F.col("assembly_name").alias("assembly"), cap("accessibility"), "signature", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.coalesce("containing_namespace_id", F.lit("")).alias("ns"))


def view_links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), X.edge_pascal().alias("type"), F.col("is_external").alias("isExternal"))
