"""Data model: node, edge and header rows, their enumerations, and the request and results of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1
NODE_KINDS = ("namespace", "type", "method", "property", "field", "event", "constructor")
EDGE_TYPES = ("contains", "calls", "inherits", "implements", "dependsOn", "resolvesTo", "covers", "coveredBy", "references", "overrides")
ACCESSIBILITY = ("public", "internal", "protected", "private", "protectedInternal", "privateProtected")

#: Schemas as DDL.
NODES = (
    "id string, name string, kind string, file_path string, start_line int, end_line int, signature string, doc_comment string, "
    "containing_type_id string, containing_namespace_id string, accessibility string, assembly_name string, metadata map<string,string>"
)
EDGES = (
    "from_id string, to_id string, type string, is_external boolean, package_source string, source_link string, resolution string, metadata map<string,string>"
)
#: What a missing field of a stored row means; fields not listed are null.
NODE_DEFAULTS = {"id": "", "name": "", "kind": NODE_KINDS[0], "file_path": "", "start_line": 0, "end_line": 0, "signature": "", "accessibility": ACCESSIBILITY[0], "assembly_name": ""}
EDGE_DEFAULTS = {"from_id": "", "to_id": "", "type": EDGE_TYPES[0], "is_external": False}


def camel(name: str) -> str:
    """Field name as stored in JSON."""
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def pascal(name: str) -> str:
    """Enumeration member as printed in texts."""
    return name[:1].upper() + name[1:]


class OutputFormat(Enum):
    JSON = "json"
    TEXT = "text"
    CONTEXT = "context"


class Change(Enum):
    """Kinds of differences between two graphs."""

    ADDED_NODES = "added-nodes"
    REMOVED_NODES = "removed-nodes"
    SIGNATURE_CHANGED = "signature-changed"
    ADDED_EDGES = "added-edges"
    REMOVED_EDGES = "removed-edges"


class SplitBy(Enum):
    """How nodes are spread over the files of a graph folder."""

    PROJECT = "project"
    NAMESPACE = "namespace"
    ASSEMBLY = "assembly"


@dataclass(frozen=True)
class Metadata:
    """Header of a stored graph; generated_at stays text, as its own offset counts."""

    schema_version: int = SCHEMA_VERSION
    commit_hash: str = ""
    branch: str = ""
    generated_at: str = "0001-01-01T00:00:00+00:00"
    indexer_version: str = ""
    solution: str = ""
    solution_name: str = ""
    projects_indexed: tuple[str, ...] = ()
    stats: dict[str, int] = field(default_factory=dict)

    @property
    def short_commit(self) -> str:
        return self.commit_hash[:7]


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; ``ord`` is the load order of nodes and edges where they carry it."""

    nodes: DataFrame
    edges: DataFrame
    meta: Metadata = Metadata()


@dataclass(frozen=True)
class QueryOptions:
    """What a subgraph query asks for."""

    pattern: str = ""
    depth: int = 1
    edge_type: str | None = None
    namespace: str | None = None
    project: str | None = None
    max_nodes: int = 50
    include_external: bool = False
    rank: bool = True
    format: OutputFormat = OutputFormat.CONTEXT


@dataclass(frozen=True)
class QueryResult:
    """Answer of a subgraph query; the counts were taken before truncation."""

    matched: DataFrame
    nodes: DataFrame
    edges: DataFrame
    meta: Metadata
    match_count: int
    truncated: bool


@dataclass(frozen=True)
class DiffResult:
    """Differences of two graphs, ready to be listed; signature_changed has id, kind, previous and current signature."""

    added_nodes: DataFrame
    removed_nodes: DataFrame
    signature_changed: DataFrame
    added_edges: DataFrame
    removed_edges: DataFrame
    base: Metadata
    head: Metadata


class GraphError(RuntimeError):
    """Something is wrong with a stored graph, a configuration or a request."""


def check_version(version: int) -> None:
    """Only graphs of the current schema version can be read."""
    if version != SCHEMA_VERSION:
        raise GraphError(f"The graph has schema version {version}, this engine reads {SCHEMA_VERSION}: index it again.")
