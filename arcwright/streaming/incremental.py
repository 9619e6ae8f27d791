"""A stored graph that follows a stream of re-indexed projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcwright.model import Graph, Metadata
from arcwright.operators import sets


def follow(changes: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges batches of (project, nodes, edges) rows into the Parquet graph below a folder, one version a batch.

    A row holds all nodes and edges of a project; of several of a project in a batch the one with the
    highest version counts. Each batch writes ``<folder>/v=<n>`` from the version before it, so one
    that is run again after a failure gives the same result.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("project").agg(F.max_by(F.struct("nodes", "edges"), "version").alias("p")).select("project", "p.nodes", "p.edges").persist()
        nodes, edges = last.select(F.explode("nodes").alias("n")).select("n.*"), last.select(F.explode("edges").alias("e")).select("e.*")
        if number:
            before = Graph(spark.read.parquet(f"{folder}/v={number - 1}/nodes"), spark.read.parquet(f"{folder}/v={number - 1}/edges"), Metadata())
            merged = sets.merge(before, Graph(nodes, edges), last.select("project"))
            nodes, edges = merged.nodes, merged.edges
        nodes.write.mode("overwrite").parquet(f"{folder}/v={number}/nodes")
        edges.write.mode("overwrite").parquet(f"{folder}/v={number}/edges")
        last.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
