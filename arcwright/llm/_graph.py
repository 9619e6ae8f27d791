"""Connected components of an edge list, and tables kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables below ``spark.checkpoint.dir``. Without that setting a local one is made for a local master, and others fail: executors couldn't share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        told = context.getConf().get("spark.checkpoint.dir")
        if not told and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder, so that a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder: smaller than what :func:`keep` writes, and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the component's lowest id; roots are not listed.

    Alternating large-star and small-star steps: their number grows with the logarithm of the
    component size, each costs two exchanges of the edges, and no node's neighbours are gathered.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = keep(small.where("u > v").distinct())
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, hot: int) -> DataFrame:
    """Inner join with a table of unique keys whose column ``n`` counts the rows of each key.

    Keys of ``hot`` rows and more are joined by broadcast, so that no task holds one key's rows; there are
    at most as many of them as rows divided by ``hot``. All others are shuffled. ``rows`` is read twice.
    """
    often = F.broadcast(keyed.where(F.col(n) >= hot))
    rest = keyed.where(F.col(n) < hot)
    return rows.join(often, on).unionByName(rows.join(often.select(*on), on, "left_anti").join(rest, on))
