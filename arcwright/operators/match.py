"""Seeds of a query: nodes that a pattern names, restricted by namespace and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X


def exact(pattern: str) -> Column:
    """The id is the pattern, or ends with a dot and the pattern."""
    return X.same("id", pattern) | X.ends("id", "." + pattern)


def partial(pattern: str) -> Column:
    """The name is the pattern, or name or id end with it."""
    return X.ends("id", pattern) | X.ends("name", pattern)


def match(nodes: DataFrame, pattern: str | None) -> DataFrame:
    """Nodes that the pattern names, whatever the case.

    A blank pattern names all. ``kind:rest`` keeps one kind of what rest names. With ``*`` the whole
    id or name must match. Otherwise exact matches count, and only if no node at all is one, of any
    kind, partial matches: candidates are tagged 1 or 2, and those of the lowest tag found stay, in
    one lazy plan without a driver-side test.
    """
    if pattern is None or not pattern.strip():
        return nodes
    kind, rest = X.parse_kind_prefix(pattern)
    if "*" in rest:
        found = nodes.where(X.matches_wildcard("id", rest) | X.matches_wildcard("name", rest))
    else:
        tier = F.when(exact(rest), 1).when(partial(rest), 2)
        tagged = nodes.withColumn("__tier", tier).where("__tier is not null")
        best = tagged.agg(F.min("__tier").alias("__best"))  # one row
        found = tagged.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")
    return found.where(F.col("kind") == kind) if kind else found


def in_namespace(nodes: DataFrame, pattern: str | None) -> DataFrame:
    """Nodes whose namespace, or whose id, matches a pattern with ``*``; all for a blank one."""
    if pattern is None or not pattern.strip():
        return nodes
    hit = F.coalesce(X.matches_wildcard("containing_namespace_id", pattern), F.lit(False))
    return nodes.where(hit | X.matches_wildcard("id", pattern))


def in_project(nodes: DataFrame, prefix: str | None) -> DataFrame:
    """Nodes whose id or namespace begins with a prefix; all for a blank one."""
    if prefix is None or not prefix.strip():
        return nodes
    return nodes.where(X.starts("id", prefix) | X.starts("containing_namespace_id", prefix))


def selected_projects(projects: DataFrame, include: list[str], exclude: list[str], column: str = "name", changed: list[str] | None = None) -> DataFrame:
    """Projects that an include pattern matches (all if none is given), none of exclude does, and, if given, that changed."""
    hit = lambda patterns: F.array_contains(F.array(*(X.matches_wildcard(column, p, question=True) for p in patterns)), True)
    found = projects.where(hit(include)) if include else projects
    found = found.where(~hit(exclude)) if exclude else found
    return found if changed is None else found.where(F.lower(column).isin([c.lower() for c in changed]))
