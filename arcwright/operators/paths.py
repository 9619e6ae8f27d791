"""Joins of paths with the nearest folder above them that holds something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X


def with_ancestors(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """A row for each folder above a path, from its own up to the root, in the column ancestor."""
    cut = F.split(X.folder(F.col("__p")), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda n: F.array_join(F.slice(cut, 1, n), "/"))
    rows = files.withColumn("__p", X.slashes(path)).withColumn("ancestor", F.explode(F.when(X.folder(F.col("__p")) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), each)))).drop("__p")
    return rows.where(F.startswith("ancestor", F.lit(root))) if root else rows


def nearest(files: DataFrame, found: DataFrame, value: str, path: str = "path", root: str = "") -> DataFrame:
    """Files with the value of the nearest folder at or above theirs that has one; found is (folder, value), the first of a folder counts.

    An equi-join on folders, at most as many rows a file as its path is deep: no comparison of all pairs.
    """
    once = found.groupBy("folder").agg(F.min(value).alias(value))
    pairs = with_ancestors(files, path, root).join(once, F.col("ancestor") == F.col("folder"))
    return pairs.groupBy(files.columns).agg(F.max_by(value, F.length("ancestor")).alias(value))


def owning_projects(files: DataFrame, projects: DataFrame, root: str = "") -> DataFrame:
    """Files with the name of the project file nearest above them; files below none are dropped."""
    found = projects.select(X.folder(X.slashes("path")).alias("folder"), X.stem("path").alias("project"))
    return nearest(files, found, "project", root=root)


def project_files(files: DataFrame, projects: DataFrame, root: str = "") -> DataFrame:
    """Files with the path of the project file nearest above them, so that projects of one name in several folders stay apart."""
    found = projects.select(X.folder(X.slashes("path")).alias("folder"), F.col("path").alias("project"))
    return nearest(files, found, "project", root=root)


def inherited(projects: DataFrame, props: DataFrame) -> DataFrame:
    """(path, key, value): properties of the nearest properties file above each project; keys whatever the case, the first value counts.

    props is (path, key, value, ord) of all properties files. Only the nearest file counts, even for keys it lacks.
    """
    files = props.select(X.folder(X.slashes("path")).alias("folder"), F.col("path").alias("source")).distinct()
    mine = nearest(projects.select("path"), files, "source")
    values = props.groupBy(F.col("path").alias("source"), F.lower("key").alias("key")).agg(F.min_by("value", "ord").alias("value"))
    return mine.join(values, "source").select("path", "key", "value")
