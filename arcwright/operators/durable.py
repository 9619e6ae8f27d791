"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast in joins with larger ones; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


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
    """The rows, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The kept table, marked for broadcast if its size allows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
