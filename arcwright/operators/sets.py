"""Federation, merging and comparison of graphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.model import Change, DiffResult, Graph, GraphError, Metadata
from arcwright.operators.durable import small


def pick(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first in the order, or the last; with partial aggregation, no sort and no window."""
    others = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    row = choose(F.struct(*others), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col("__row")[c].alias(c) for c in others)).select(df.columns)


def last_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes of equal id the one loaded last."""
    return pick(nodes, ["id"], ["ord"], last=True)


def federate(nodes: DataFrame, edges: DataFrame, solution: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several solutions as one graph: of equal ids, or equal ends and type, the first by solution and load order.

    ``solution`` scopes to one of them, whatever the case; stored by solution, only its files are read.
    """
    if solution is not None:
        nodes, edges = (df.where(X.same("solution", solution)) for df in (nodes, edges))
    return pick(nodes, ["id"], ["solution", "ord"]), pick(edges, ["from_id", "to_id", "type"], ["solution", "ord"])


def federate_metadata(metas: list[Metadata]) -> Metadata:
    """The first header with all solutions' names and all projects; its counts and commit stay its own."""
    if not metas:
        raise GraphError("There is no graph of that solution")
    if len(metas) == 1:
        return metas[0]
    names = ", ".join(m.solution_name or m.solution for m in metas)
    projects = tuple(dict.fromkeys(p for m in metas for p in m.projects_indexed))
    return replace(metas[0], solution_name=names, solution=names + ".sln", projects_indexed=projects)


def merge(existing: Graph, partial: Graph, projects: list[str] | DataFrame, by: str = "segment") -> Graph:
    """A graph after some of its projects were indexed again.

    Nodes of the projects go, then those of the partial graph are put in, over any of equal id. Edges
    that start at a node that went go, edges into it stay; the partial graph's edges are added as they
    are. ``by`` tells a node's project: ``segment`` by its id up to the first dot, ``assembly`` by its
    assembly's name.
    """
    spark = existing.nodes.sparkSession
    keys = projects.toDF("project") if isinstance(projects, DataFrame) else spark.createDataFrame([(p,) for p in projects], "project string")
    key = X.first_segment("id") if by == "segment" else F.col("assembly_name")
    tagged = existing.nodes.withColumn("project", key)
    gone = tagged.join(small(keys), "project", "left_semi").select("id")
    kept = tagged.join(small(keys), "project", "left_anti").select(existing.nodes.columns)
    kept = kept.join(partial.nodes.select("id"), "id", "left_anti").select(existing.nodes.columns)
    edges = existing.edges.join(gone.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_anti").select(existing.edges.columns)
    names = tuple(dict.fromkeys(existing.meta.projects_indexed + partial.meta.projects_indexed))
    meta = replace(partial.meta, projects_indexed=names)
    return Graph(kept.unionByName(partial.nodes, allowMissingColumns=True), edges.unionByName(partial.edges, allowMissingColumns=True), meta)


_EDGE_KEY = ["from_id", "to_id", "type", "is_external", "__resolution"]


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__resolution", F.coalesce("resolution", F.lit("")))


def once(edges: DataFrame) -> DataFrame:
    """One edge of each (from, to, type, external, resolution)."""
    keyed = _keyed(edges)
    keyed = pick(keyed, _EDGE_KEY, ["ord"]) if "ord" in edges.columns else keyed.dropDuplicates(_EDGE_KEY)
    return keyed.select(edges.columns)


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of a that b has not, one of each (from, to, type, external, resolution)."""
    return _keyed(once(a)).join(_keyed(b).select(_EDGE_KEY), _EDGE_KEY, "left_anti").select(a.columns)


def diff(base: Graph, head: Graph, apart: tuple[DataFrame, DataFrame] | None = None) -> DiffResult:
    """What changed from one graph to another, each list in its order: by id, or by ends and the type's printed name.

    Edges of both graphs are compared, unless ``apart`` names those that only head has and those that
    only base has, as it can where both were made from one table by a rule on the ends. None of them
    may equal an edge of the other graph; of equal ones among them one is listed.
    """
    added = head.nodes.join(base.nodes.select("id"), "id", "left_anti").select(head.nodes.columns)
    removed = base.nodes.join(head.nodes.select("id"), "id", "left_anti").select(base.nodes.columns)
    old = base.nodes.select("id", F.col("signature").alias("previous"))
    changed = head.nodes.select("id", "kind", F.col("signature").alias("current")).join(old, "id")
    changed = changed.where(F.coalesce("previous", F.lit("")) != F.coalesce("current", F.lit(""))).select("id", "kind", "previous", "current")
    edge_order = ("from_id", "to_id", X.edge_pascal())
    more, less = (diff_edges(head.edges, base.edges), diff_edges(base.edges, head.edges)) if apart is None else map(once, apart)
    return DiffResult(added.orderBy("id"), removed.orderBy("id"), changed.orderBy("id"), more.orderBy(*edge_order), less.orderBy(*edge_order), base.meta, head.meta)


def diff_counts(result: DiffResult) -> DataFrame:
    """(change, n) of each kind of difference."""
    lists = zip(Change, (result.added_nodes, result.removed_nodes, result.signature_changed, result.added_edges, result.removed_edges))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(c.value).alias("change"), "n") for c, df in lists]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_ONLY = {"added": (Change.ADDED_NODES, Change.ADDED_EDGES), "removed": (Change.REMOVED_NODES, Change.REMOVED_EDGES), **{c.value: (c,) for c in Change}}


def parse_changes(text: str | None) -> frozenset[Change]:
    """Kinds of differences of a list such as ``added,signature-changed``; none for a blank one."""
    found: set[Change] = set()
    for token in (text or "").split(","):
        if token.strip():
            if token.strip().lower() not in _ONLY:
                raise GraphError(f"'{token.strip()}' is no kind of difference; there are {', '.join(_ONLY)}")
            found |= set(_ONLY[token.strip().lower()])
    return frozenset(found)


def only(result: DiffResult, changes: frozenset[Change]) -> DiffResult:
    """The result with just these lists, the others empty; all if none is named."""
    if not changes:
        return result
    fields = dict(zip(Change, ("added_nodes", "removed_nodes", "signature_changed", "added_edges", "removed_edges")))
    return replace(result, **{f: getattr(result, f).limit(0) for c, f in fields.items() if c not in changes})
