"""Which file of a graph folder a node or an edge belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.model import SplitBy

EXTERNAL, DEFAULT = "_external", "_default"


def group_key(by: SplitBy = SplitBy.ASSEMBLY) -> Column:
    """Group of a node: by first id segment, by all but the last, or by assembly, where external nodes have their own."""
    if by is SplitBy.PROJECT:
        key = X.first_segment("id")
    elif by is SplitBy.NAMESPACE:
        key = X.parent_segment("id")
    else:
        outside = (F.coalesce("file_path", F.lit("")) == "") & F.coalesce(F.map_contains_key("metadata", F.lit("assembly")), F.lit(False))
        named = F.coalesce(F.col("assembly_name"), F.lit("")) != ""
        key = F.when(outside, EXTERNAL).when(named, F.col("assembly_name")).otherwise(X.first_segment("id"))
    return F.when(key == "", DEFAULT).otherwise(key)


def group_nodes(nodes: DataFrame, by: SplitBy = SplitBy.ASSEMBLY) -> DataFrame:
    """Nodes with their group; of equal ids in a group the one that came last stays."""
    from arcwright.operators.sets import pick

    keyed = nodes.withColumn("group", group_key(by))
    return pick(keyed, ["group", "id"], ["ord"], last=True) if "ord" in nodes.columns else keyed.dropDuplicates(["group", "id"])


def group_edges(edges: DataFrame, grouped: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Edges with the group of the node they start at; of an unknown one, the first group, or they are dropped.

    The first group is that of the first node in load order, ``_default`` without any nodes. A node
    of several groups counts in the last by load order.
    """
    order = ["ord", "group"] if "ord" in grouped.columns else ["group"]
    home = grouped.groupBy(F.col("id").alias("from_id")).agg(F.max_by("group", F.struct(*order)).alias("group"))
    if drop_unknown:
        return edges.join(home, "from_id").select(*edges.columns, "group")
    first = grouped.agg(F.coalesce(F.min_by("group", F.struct(*order)), F.lit(DEFAULT)).alias("first_group"))
    return edges.join(home, "from_id", "left").crossJoin(F.broadcast(first)).select(*edges.columns, F.coalesce("group", "first_group").alias("group"))
