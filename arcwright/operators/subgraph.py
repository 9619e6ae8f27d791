"""The subgraph query: match, restrict, traverse, induce, filter, rank, cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcwright.model import Graph, QueryOptions, QueryResult
from arcwright.operators import match as M
from arcwright.operators import rank as R
from arcwright.operators import traverse as T
from arcwright.operators.durable import keep


def query(graph: Graph, options: QueryOptions, collation: str | None = "UNICODE", near: str | None = None) -> QueryResult:
    """Answers a request over a graph.

    Namespace and project restrict the seeds alone, the edge type the returned edges alone;
    external edges are neither walked nor returned unless asked for. What exceeds ``max_nodes`` is
    cut to the best nodes and all seeds, so that seeds may exceed it. Nodes of the project ``near``
    rank first; if it isn't given, those of the seed's namespace, if there is one seed.
    """
    seeds = M.in_project(M.in_namespace(M.match(graph.nodes, options.pattern), options.namespace), options.project)
    seeds = keep(seeds)
    count = seeds.count()
    reached = T.traverse(seeds, graph.edges, options.depth, options.include_external)
    nodes = keep(T.induced_nodes(graph.nodes, reached))
    edges = T.induced_edges(graph.edges, reached)
    if options.edge_type is not None:
        edges = edges.where(F.col("type") == options.edge_type)
    if not options.include_external:
        edges = edges.where(~F.col("is_external"))
    truncated = nodes.count() > options.max_nodes
    if truncated:
        if options.rank:
            if near is None and count == 1:
                near = seeds.select("containing_namespace_id").first()[0]
            ids = R.best_ids(nodes, seeds, T.direct_neighbours(reached), R.external_ids(graph.edges), near, options.max_nodes, collation)
        else:
            ids = R.first_ids(nodes, reached, seeds, options.max_nodes)
        nodes, edges = R.cut(nodes, edges, keep(ids))
    return QueryResult(seeds, nodes, edges, graph.meta, count, truncated)
