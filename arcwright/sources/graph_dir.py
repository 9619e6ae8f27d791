"""Graph folders: a header ``meta.json`` and JSON files of nodes and edges, read and written."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcwright.functions import text as X
from arcwright.model import EDGE_DEFAULTS, EDGES, NODE_DEFAULTS, NODES, Graph, GraphError, Metadata, SplitBy, camel, check_version
from arcwright.operators import sets, split

HEADER = "meta.json"


def _stored(ddl: str) -> str:
    """The DDL with the names that JSON has."""
    return ", ".join(f"`{camel(n)}` {t}" for n, t in (c.split(" ", 1) for c in ddl.split(", ")))


_FILE = f"struct<projectOrNamespace: string, nodes: map<string, struct<{', '.join(c.replace('` ', '`: ') for c in _stored(NODES).split(', '))}>>, edges: array<struct<{', '.join(c.replace('` ', '`: ') for c in _stored(EDGES).split(', '))}>>>"


class _OneFile(InputPartition):
    def __init__(self, path: str, solution: str, number: int):
        self.path, self.solution, self.number = path, solution, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])

    def partitions(self):
        return [_OneFile(*f) for f in self.files]

    def read(self, partition):
        with open(partition.path, encoding="utf-8-sig") as f:
            yield partition.solution, partition.number, f.read()


class GraphFiles(DataSource):
    """Whole files of graph folders, one a partition; also those that begin with an underscore, which Spark's own sources hide."""

    @classmethod
    def name(cls) -> str:
        return "graph_files"

    def schema(self) -> str:
        return "solution string, file int, content string"

    def reader(self, schema):
        return _Reader(self.options)


def read_metadata(folder: str | Path) -> Metadata:
    """Header of a folder, checked; a missing one is a FileNotFoundError."""
    path = Path(folder) / HEADER
    if not path.is_file():
        raise FileNotFoundError(f"No {HEADER} in {folder}")
    raw = json.loads(path.read_text("utf-8-sig"))
    fields = {f: raw[camel(f)] for f in Metadata.__dataclass_fields__ if raw.get(camel(f)) is not None}
    if "projects_indexed" in fields:
        fields["projects_indexed"] = tuple(fields["projects_indexed"])
    meta = Metadata(**fields)
    check_version(meta.schema_version)
    return meta


def _files(folder: Path, solution: str) -> list[tuple[str, str, int]]:
    names = sorted(n for n in os.listdir(folder) if n.lower().endswith(".json") and n.lower() != HEADER and (folder / n).is_file())
    return [(str(folder / n), solution, i) for i, n in enumerate(names)]


def _decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = files.withColumn("g", F.from_json("content", _FILE)).where("g is not null").select("solution", "file", "g")
    order = lambda pos: (F.col("file").cast("bigint") * 1_000_000_000 + pos).alias("ord")
    node = parsed.select("solution", "file", F.posexplode(F.map_entries("g.nodes")).alias("pos", "n"))
    edge = parsed.select("solution", "file", F.posexplode("g.edges").alias("pos", "e"))

    def columns(cell: str, ddl: str, defaults: dict) -> list[Column]:
        out = []
        for name in (c.split(" ")[0] for c in ddl.split(", ")):
            value = F.col(f"{cell}.{camel(name)}")
            if name == "metadata":
                value = F.coalesce(value, F.create_map().cast("map<string,string>"))
            elif name in defaults:
                value = F.coalesce(value, F.lit(defaults[name]))
            out.append(value.alias(name))
        return out

    nodes = node.select(F.col("n.key").alias("__key"), *columns("n.value", NODES, NODE_DEFAULTS), "solution", order(F.col("pos")))
    nodes = nodes.withColumn("id", F.when(F.col("id") == "", F.col("__key")).otherwise(F.col("id"))).drop("__key")
    return nodes, edge.select(*columns("e", EDGES, EDGE_DEFAULTS), "solution", order(F.col("pos")))


def _scan(spark: SparkSession, files: list[tuple[str, str, int]]) -> tuple[DataFrame, DataFrame]:
    spark.dataSource.register(GraphFiles)
    return _decode(spark.read.format("graph_files").option("files", json.dumps(files)).load())


def read_graph(spark: SparkSession, folder: str | Path) -> Graph:
    """The graph of one folder: of equal node ids the last counts, edges are all kept."""
    meta = read_metadata(folder)
    nodes, edges = _scan(spark, _files(Path(folder), ""))
    return Graph(sets.last_nodes(nodes).drop("solution"), edges.drop("solution"), meta)


def load(spark: SparkSession, folder: str | Path, solution: str | None = None) -> Graph:
    """A folder's graph; if folders in it hold graphs, those as one, or the one named like ``solution``."""
    folder = Path(folder)
    parts = sorted(p for p in folder.iterdir() if (p / HEADER).is_file()) if folder.is_dir() else []
    if not parts:
        return read_graph(spark, folder)
    parts = [p for p in parts if solution is None or p.name.lower() == solution.lower()]
    if not parts:
        raise FileNotFoundError(f"No graph of solution '{solution}' in {folder}")
    metas = [read_metadata(p) for p in parts]
    nodes, edges = _scan(spark, [f for p in parts for f in _files(p, p.name)])
    last = sets.pick(nodes, ["solution", "id"], ["ord"], last=True)
    return Graph(*sets.federate(last, edges), sets.federate_metadata(metas))


def _json_names(df: DataFrame, ddl: str) -> Column:
    return F.struct(*(F.col(n).alias(camel(n)) for n in (c.split(" ")[0] for c in ddl.split(", ")) if n in df.columns))


def file_contents(graph: Graph, by: SplitBy = SplitBy.ASSEMBLY) -> DataFrame:
    """(name, content): what each file of the folder holds."""
    grouped = split.group_nodes(graph.nodes, by)
    edges = split.group_edges(graph.edges, grouped)
    entry = F.struct("id", _json_names(grouped, NODES).alias("node"))
    per = grouped.groupBy("group").agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
    out = edges.groupBy("group").agg(F.collect_list(_json_names(edges, EDGES)).alias("edges"))
    both = per.join(out, "group", "full")
    body = F.struct(F.col("group").alias("projectOrNamespace"), F.col("nodes"), F.coalesce("edges", F.array()).alias("edges"))
    return both.select(F.concat(X.file_name("group"), F.lit(".json")).alias("name"), F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"}).alias("content"))


def write_graph(graph: Graph, folder: str | Path, by: SplitBy = SplitBy.ASSEMBLY) -> None:
    """Writes the header and a file for each group; files of other groups stay. The folder must be one that all machines share."""
    target = str(Path(folder).absolute())
    os.makedirs(target, exist_ok=True)

    def store(rows) -> None:
        for row in rows:
            partial = os.path.join(target, f".{row['name']}.{os.getpid()}")
            with open(partial, "w", encoding="utf-8") as f:
                f.write(row["content"])
            os.replace(partial, os.path.join(target, row["name"]))  # a task that runs twice leaves a whole file

    file_contents(graph, by).foreachPartition(store)
    write_metadata(graph.meta, target)


def write_metadata(meta: Metadata, folder: str | Path) -> None:
    raw = {camel(k): list(v) if isinstance(v, tuple) else v for k, v in asdict(meta).items()}
    Path(folder, HEADER).write_text(json.dumps(raw, indent=2, ensure_ascii=False), "utf-8")


def write_parquet(graph: Graph, folder: str, by: SplitBy = SplitBy.ASSEMBLY) -> None:
    """The same groups as Parquet, partitioned by group, for graphs that JSON is too slow for."""
    grouped = split.group_nodes(graph.nodes, by)
    grouped.repartition("group").write.mode("overwrite").partitionBy("group").parquet(f"{folder}/nodes")
    split.group_edges(graph.edges, grouped).repartition("group", "from_id").write.mode("overwrite").partitionBy("group").parquet(f"{folder}/edges")


def read_parquet(spark: SparkSession, folder: str, meta: Metadata = Metadata()) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), meta)


def require(folder: str | Path) -> Path:
    if not Path(folder).is_dir():
        raise GraphError(f"There is no folder {folder}")
    return Path(folder)
