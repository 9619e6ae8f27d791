"""The engine as a JSON-RPC service over standard input and output, and as commands."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession, functions

from arcwright.functions.text import EDGE_ALIASES, parse_edge_type, ref_name
from arcwright.model import GraphError, OutputFormat, QueryOptions, SplitBy
from arcwright.operators import extract, sets
from arcwright.operators.subgraph import query
from arcwright.plans import render
from arcwright.sources import config, csharp, graph_dir, projects

TOOL = "graph_query"
_KINDS = sorted(EDGE_ALIASES)


def tool_schema() -> dict:
    """The one tool and its nine parameters."""
    field = lambda kind, text, **more: {"type": kind, "description": text, **more}
    properties = {
        "symbol": field("string", "Name or pattern of symbols, with * and kind:name"),
        "depth": field("integer", "Hops from the matched symbols", default=1),
        "kind": field("string", "Type of the edges returned", enum=_KINDS),
        "namespace": field("string", "Namespace of the matched symbols, with *"),
        "project": field("string", "What ids or namespaces of the matched symbols begin with"),
        "format": field("string", "Form of the answer", enum=["context", "json", "text"], default="context"),
        "max_nodes": field("integer", "Nodes to return at most", default=50),
        "include_external": field("boolean", "Walk and return edges to outside symbols", default=False),
        "solution": field("string", "One solution of several"),
    }
    return {"name": TOOL, "description": "Symbols of the indexed sources and what is around them", "inputSchema": {"type": "object", "properties": properties, "required": ["symbol"]}}


class Service:
    """Answers JSON-RPC messages about the graph in a folder; it is read again only when another solution is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.graph, self.solution = spark, folder, None, None

    def handle(self, message: dict) -> dict | None:
        id_, method, params = message.get("id"), message.get("method"), message.get("params") or {}
        if method == "initialize":
            return _result(id_, {"protocolVersion": params.get("protocolVersion") or "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "arcwright", "version": "0.1.0"}})
        if method == "notifications/initialized":
            return None
        if method == "tools/list":
            return _result(id_, {"tools": [tool_schema()]})
        if method == "tools/call":
            return self._call(id_, params)
        if method == "ping":
            return _result(id_, {})
        return _error(id_, -32601, f"Method not found: {method}") if id_ is not None else None

    def _call(self, id_, params: dict) -> dict:
        if params.get("name") != TOOL:
            return _error(id_, -32602, f"Unknown tool: {params.get('name')}")
        a = params.get("arguments") or {}
        symbol = a.get("symbol")
        if not symbol:
            return _error(id_, -32602, "Missing required parameter: symbol")
        try:
            if self.graph is None or a.get("solution") != self.solution:
                for df in (self.graph.nodes, self.graph.edges) if self.graph is not None else ():
                    df.unpersist()
                self.graph, self.solution = graph_dir.load(self.spark, self.folder, a.get("solution")), a.get("solution")
                for df in (self.graph.nodes, self.graph.edges):
                    df.persist()
            form = {"json": OutputFormat.JSON, "text": OutputFormat.TEXT}.get(str(a.get("format", "")).lower(), OutputFormat.CONTEXT)
            options = QueryOptions(symbol, a.get("depth", 1), parse_edge_type(a.get("kind")), a.get("namespace"), a.get("project"), a.get("max_nodes", 50), bool(a.get("include_external", False)), True, form)
            result = query(self.graph, options)
            if not result.match_count:
                return _said(id_, f"No nodes found matching '{symbol}'.", True)
            return _said(id_, render.answer(result, form, f"{symbol} --depth {options.depth} --kind {a.get('kind') or 'all'}"), False)
        except FileNotFoundError as e:
            return _said(id_, f"{e}\nIndex the sources first.", True)
        except Exception as e:
            return _said(id_, str(e), True)


def _result(id_, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def _error(id_, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def _said(id_, text: str, failed: bool) -> dict:
    return _result(id_, {"content": [{"type": "text", "text": text}], "isError": failed})


def serve(handle: Callable[[dict], dict | None], source: BinaryIO, sink: BinaryIO) -> None:
    """Reads messages until the end: with Content-Length headers if the first line is one, else a line each; bad JSON is passed over."""
    framed: bool | None = None
    while line := source.readline():
        if not line.strip():
            continue
        if framed is None:
            framed = line.lower().startswith(b"content-length:")
        if framed:
            size = 0
            while line.strip():
                key, _, value = line.partition(b":")
                size = int(value) if key.strip().lower() == b"content-length" else size
                line = source.readline()
            line = source.read(size)
        try:
            message = json.loads(line)
        except ValueError:
            continue
        reply = handle(message) if isinstance(message, dict) else None
        if reply is not None:
            body = json.dumps(reply, ensure_ascii=False).encode()
            sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(body), body) if framed else body + b"\n")
            sink.flush()


def _session() -> SparkSession:
    return SparkSession.builder.appName("arcwright").getOrCreate()


def index_all(spark: SparkSession, root: str, output: str, settings: config.Config, project_filter: str | None = None, changed_only: bool = False) -> tuple[int, list[str]]:
    """Indexes the configured solutions, several each into a folder of its name, or all projects below the root; (projects, solutions that failed).

    A solution that fails doesn't stop the others.
    """
    solutions, total, failed = settings.effective_solutions(), 0, []
    for solution in solutions or [None]:
        target = output if len(solutions) < 2 else str(Path(output) / Path(solution.replace("\\", "/")).stem)
        try:
            total += index(spark, root, target, settings, project_filter, changed_only, solution)
        except Exception as e:
            if len(solutions) < 2:
                raise
            failed.append(f"{solution}: {e}")
    return total, failed


def index(spark: SparkSession, root: str, output: str, settings: config.Config, project_filter: str | None = None, changed_only: bool = False, solution: str | None = None) -> int:
    """Indexes the C# sources of a solution's projects, or of all below a folder, into a graph folder; the number of projects."""
    found = projects.read_texts(spark, root, "*.csproj")
    if solution is not None:
        path = Path(root, solution.replace("\\", "/"))
        if not path.is_file():
            raise FileNotFoundError(f"No solution at {path}")
        listed = projects.all_solution_projects(projects.in_memory(spark, {path.absolute().as_posix(): path.read_text("utf-8-sig")})).collect()
        wanted = [os.path.normpath(path.absolute().parent / r["path"]).lower() for r in listed]
        found = found.where(functions.lower("path").isin(wanted))
    table = projects.project_table(found, projects.read_texts(spark, root, "Directory.Build.props"))
    from arcwright.functions.text import stem
    from arcwright.operators import binding
    from arcwright.operators.match import selected_projects
    from arcwright.operators.paths import project_files

    include = [project_filter] if project_filter else settings.projects.include
    old = graph_dir.read_metadata(output).commit_hash if changed_only and (Path(output) / graph_dir.HEADER).is_file() else ""
    table = table.withColumn("project", functions.col("path"))
    chosen = selected_projects(table.withColumn("stem", stem("path")), include, settings.projects.exclude, "stem")
    if old:
        files = config.changed_files(old, root)
        if not files:
            return 0
        top = config.git("rev-parse", "--show-toplevel", folder=root) or Path(root).absolute().as_posix()
        touched = project_files(spark.createDataFrame([(f"{top}/{f}",) for f in files], "path string"), found.select("path"))
        chosen = chosen.join(touched.select("project").distinct(), "project", "left_semi")
    names = [r[0] for r in chosen.select("assembly").distinct().collect()]
    mine = project_files(projects.source_files(spark, root), found.select("path")).join(chosen.select("project", "assembly"), "project")
    mine = mine.select("assembly", functions.col("path").alias("file"), "content")
    others = types = None
    if old:
        stored = graph_dir.read_graph(spark, output)
        others = binding.stored(stored.nodes.where(~functions.col("assembly_name").isin(names)), stored.edges)
        types = others.where("kind = 'type'").withColumnRenamed("symbol_id", "id")
    decls, refs = csharp.facts(mine, types)
    graph = extract.extract(decls, csharp.bind(decls, refs, others), csharp.registrations(refs), root, others)
    from dataclasses import replace
    from datetime import UTC, datetime

    meta = replace(graph.meta, commit_hash=config.git("rev-parse", "HEAD", folder=root), branch=config.git("rev-parse", "--abbrev-ref", "HEAD", folder=root), generated_at=datetime.now(UTC).isoformat(), indexer_version="0.1.0", solution_name=Path(root).absolute().name, projects_indexed=tuple(names))
    graph = replace(graph, meta=meta)
    if old:
        graph = sets.merge(graph_dir.read_graph(spark, output), graph, names, by="assembly")
    from arcwright.operators.durable import keep
    from arcwright.operators.views import stats

    graph = replace(graph, nodes=keep(graph.nodes), edges=keep(graph.edges))
    graph = replace(graph, meta=replace(graph.meta, stats=stats(graph.nodes, graph.edges).first().asDict()))
    graph_dir.write_graph(graph, output, SplitBy(settings.split_by) if settings.split_by != "project" else SplitBy.ASSEMBLY)
    return len(names)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Commands query, diff, index, view and serve; 0 if all went well."""
    out = out or sys.stdout
    p = argparse.ArgumentParser("arcwright")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("pattern")
    for name, kind, default in (("depth", int, 1), ("kind", str, None), ("namespace", str, None), ("project", str, None), ("format", str, "context"), ("max-nodes", int, 50), ("graph-dir", str, ".arcwright"), ("from", str, None)):
        q.add_argument(f"--{name}", type=kind, default=default)
    q.add_argument("--include-external", action="store_true")
    q.add_argument("--no-rank", action="store_true")
    d = sub.add_parser("diff")
    for name, default in (("base", None), ("head", ".arcwright"), ("ref", None), ("format", "context"), ("only", None)):
        d.add_argument(f"--{name}", default=default)
    i = sub.add_parser("index")
    i.add_argument("--root", default=".")
    i.add_argument("--output")
    i.add_argument("--config")
    i.add_argument("--projects")
    i.add_argument("--changed-only", action="store_true")
    v = sub.add_parser("view")
    v.add_argument("--graph-dir", default=".arcwright")
    v.add_argument("--output", required=True)
    v.add_argument("--max-nodes", type=int, default=5000)
    s = sub.add_parser("serve")
    s.add_argument("--graph-dir", default=".arcwright")
    a = p.parse_args(argv)
    try:
        if a.command == "query":
            kind = parse_edge_type(a.kind)
            form = {"json": OutputFormat.JSON, "text": OutputFormat.TEXT}.get(a.format.lower(), OutputFormat.CONTEXT)
            graph = graph_dir.load(spark or _session(), a.graph_dir, getattr(a, "from"))
            if warning := config.stale(a.graph_dir):
                print(warning, file=sys.stderr)
            result = query(graph, QueryOptions(a.pattern, a.depth, kind, a.namespace, a.project, a.max_nodes, a.include_external, not a.no_rank, form))
            if not result.match_count:
                print(f"No nodes found matching '{a.pattern}'.", file=sys.stderr)
                return 1
            print(render.answer(result, form, f"{a.pattern} --depth {a.depth} --kind {a.kind or 'all'}"), file=out)
        elif a.command == "diff":
            base = a.base
            if base is None and a.ref:
                named = [f".arcwright-{ref_name(a.ref)}", f".arcwright-{config.git('rev-parse', a.ref)[:7]}"]
                base = next((n for n in named if Path(n).is_dir()), named[0])
            if base is None:
                raise GraphError("Give --base or --ref")
            changes = sets.parse_changes(a.only)
            session = spark or _session()
            found = sets.only(sets.diff(graph_dir.read_graph(session, base), graph_dir.read_graph(session, a.head)), changes)
            print({"json": render.diff_json, "text": render.diff_text}.get(a.format.lower(), render.diff_context)(found), file=out)
        elif a.command == "index":
            settings = config.load_config(a.config, a.root)
            n, failed = index_all(spark or _session(), a.root, a.output or settings.output, settings, a.projects, a.changed_only)
            print(f"Indexed {n} projects", file=out)
            if failed:
                raise GraphError("; ".join(failed))
        elif a.command == "view":
            if a.max_nodes <= 0:
                raise GraphError("--max-nodes must be above 0")
            Path(a.output).write_text(render.page(graph_dir.read_graph(spark or _session(), a.graph_dir), a.max_nodes), "utf-8")
        else:
            serve(Service(spark or _session(), a.graph_dir).handle, sys.stdin.buffer, sys.stdout.buffer)
    except (GraphError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
