"""Answers as texts: the subgraph and the differences, for reading, for programs and for a page."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Row

from arcwright.functions.text import escape_html
from arcwright.model import EDGE_TYPES, DiffResult, Graph, Metadata, OutputFormat, QueryResult, camel, pascal
from arcwright.operators import views as V

#: Headings of a type's edges that lead out of the targets, and into them.
_OUT = dict(zip(EDGE_TYPES, ("Contains", "Calls (outgoing)", "Inherits", "Implements", "Depends on", "Resolves via IOC", "Covered by tests", "CoveredBy", "References (outgoing)", "Overrides")))
_IN = dict(zip(EDGE_TYPES, ("Contained in", "Called by (incoming)", "Inherited by", "Implemented by", "Depended on by", "Resolved from", "Covers", "CoveredBy (incoming)", "Referenced by (incoming)", "Overridden by")))


class _Answer:
    """A result's rows on the driver; results are cut to a number of nodes, so they are few."""

    def __init__(self, result: QueryResult):
        order = ["id"]
        self.matched: list[Row] = result.matched.orderBy(*order).collect()
        self.nodes: dict[str, Row] = {n["id"]: n for n in result.nodes.orderBy(*order).collect()}
        self.by_type: dict[str, list[Row]] = defaultdict(list)
        edges = sorted(result.edges.collect(), key=lambda e: (EDGE_TYPES.index(e["type"]), e["from_id"], e["to_id"]))
        self.edges = edges
        for e in edges:
            self.by_type[e["type"]].append(e)
        self.target = self.matched[0] if result.match_count == 1 else None
        self.notice = f"⚠ Results truncated. Showing subset of {result.match_count} total matches." if result.truncated else None


def _detail(node: Row, edge: Row | None = None) -> list[str]:
    lines = [f"- {node['id']}"]
    if node["file_path"]:
        lines.append(f"  File: {node['file_path']}:{node['start_line']}-{node['end_line']}")
    lines += [f"  {label}{node[column]}" for label, column in (("Sig:  ", "signature"), ("Doc:  ", "doc_comment")) if node[column]]
    if edge is not None and edge["resolution"] is not None:
        lines.append(f"  Resolution: {edge['resolution']}")
    return lines


def context(result: QueryResult, description: str | None = None) -> str:
    """The subgraph around its targets, section by section."""
    a, meta = _Answer(result), result.meta
    lines = [f"# Subgraph for {(a.target or (a.matched[0] if a.matched else {'id': 'query'}))['id']}", f"## Commit: {meta.short_commit} ({meta.branch}, {meta.generated_at[:10]})"]
    if description is not None:
        lines.append(f"## Query: {description}")
    lines.append("")
    if a.matched:
        lines.append("### Target" if a.target else f"### Matched Nodes ({len(a.matched)})")
        for node in a.matched:
            lines += _detail(node)
        lines.append("")
    targets = {n["id"] for n in a.matched}
    ways = (
        (_OUT, "to_id", lambda e: e["from_id"] in targets),
        (_IN, "from_id", lambda e: e["to_id"] in targets and e["from_id"] not in targets),
    )
    for headings, far, belongs in ways:
        for kind in EDGE_TYPES:
            own = [e for e in a.by_type.get(kind, ()) if belongs(e)]
            if own:
                lines.append(f"### {headings[kind]}")
                for e in own:
                    node = a.nodes.get(e[far])
                    lines += _detail(node, e) if node is not None else [f"- {e[far]}"]
                lines.append("")
    return "\n".join([*lines, *([a.notice] if a.notice else [])]).rstrip()


def text(result: QueryResult) -> str:
    """The subgraph in short: targets, counts, and edges by type and names."""
    a = _Answer(result)
    lines: list[str] = []
    if a.target is not None:
        n = a.target
        lines += [f"Target: {n['id']} ({pascal(n['kind'])})", f"  File: {n['file_path']}:{n['start_line']}-{n['end_line']}"]
        lines += [f"  Sig:  {n['signature']}"] if n["signature"] else []
        lines.append("")
    elif a.matched:
        lines += [f"Matched Nodes ({len(a.matched)}):", *(f"  - {n['id']} ({pascal(n['kind'])})" for n in a.matched), ""]
    lines += [f"Subgraph: {len(a.nodes)} nodes, {len(a.edges)} edges", ""]
    name = lambda i: a.nodes[i]["name"] if i in a.nodes else i
    for kind in (k for k in EDGE_TYPES if a.by_type.get(k)):
        lines += [f"{pascal(kind)} ({len(a.by_type[kind])}):", *(f"  {name(e['from_id'])} -> {name(e['to_id'])}" for e in a.by_type[kind]), ""]
    return "\n".join([*lines, *([a.notice] if a.notice else [])]).rstrip()


def _plain(row: Row) -> dict:
    """A row as stored, without what is null and without internal columns."""
    return {camel(k): v for k, v in row.asDict(True).items() if v is not None and k not in ("ord", "solution", "outside")}


def _header(meta: Metadata) -> dict:
    return {camel(k): list(v) if isinstance(v, tuple) else v for k, v in meta.__dict__.items() if v is not None}


def as_json(result: QueryResult) -> str:
    a = _Answer(result)
    body = {"targetNode": _plain(a.target) if a.target is not None else None, "matchedNodes": [_plain(n) for n in a.matched], "nodes": {i: _plain(n) for i, n in a.nodes.items()}, "edges": [_plain(e) for e in a.edges], "metadata": _header(result.meta), "wasTruncated": result.truncated, "totalMatchCount": result.match_count}
    return json.dumps({k: v for k, v in body.items() if v is not None}, indent=2, ensure_ascii=False)


def answer(result: QueryResult, form: OutputFormat, description: str | None = None) -> str:
    return as_json(result) if form is OutputFormat.JSON else text(result) if form is OutputFormat.TEXT else context(result, description)


def _commits(d: DiffResult) -> str:
    return f"{d.base.short_commit or 'unknown'}..{d.head.short_commit or 'unknown'}"


def diff_context(d: DiffResult) -> str:
    """All differences, list by list."""

    def node(n: Row) -> str:
        place = ""
        if n["file_path"] and n["file_path"].strip():
            lines = f":{n['start_line']}-{n['end_line']}" if (n["start_line"] or 0) > 0 and (n["end_line"] or 0) > 0 else ""
            place = f" — {n['file_path']}{lines}"
        return f"- {n['id']} ({pascal(n['kind'])}){place}"

    def edge(e: Row) -> str:
        how = "" if e["resolution"] is None else f", {e['resolution']}"
        return f"- {e['from_id']} → {e['to_id']} ({pascal(e['type'])}{how})"

    change = lambda c: f"- {c['id']}\n  - Was: {c['previous']}\n  + Now: {c['current']}"
    parts = (("Added Nodes", d.added_nodes, node), ("Removed Nodes", d.removed_nodes, node), ("Changed Signatures", d.signature_changed, change), ("New Edges", d.added_edges, edge), ("Removed Edges", d.removed_edges, edge))
    lines = [f"# Graph Diff: {_commits(d)}"]
    for title, df, line in parts:
        rows = df.collect()
        lines += ["", f"## {title} ({len(rows)})", *([line(r) for r in rows] or ["- None"])]
    return "\n".join(lines).rstrip()


def diff_text(d: DiffResult) -> str:
    """The numbers of differences; only they leave the cluster."""
    parts = (("Added nodes", d.added_nodes), ("Removed nodes", d.removed_nodes), ("Signature changes", d.signature_changed), ("Added edges", d.added_edges), ("Removed edges", d.removed_edges))
    return "\n".join([f"Graph Diff {_commits(d)}", *(f"{title}: {df.count()}" for title, df in parts)])


def diff_json(d: DiffResult) -> str:
    if d is None:
        raise ValueError("There is no result")
    lists = {n: [_plain(r) for r in getattr(d, n).collect()] for n in ("added_nodes", "removed_nodes", "signature_changed", "added_edges", "removed_edges")}
    return json.dumps({"baseMetadata": _header(d.base), "headMetadata": _header(d.head), **{camel(k): v for k, v in lists.items()}}, indent=2, ensure_ascii=False)


def page(graph: Graph, most: int = 5000) -> str:
    """A page that shows a sample of the graph: list and links, filtered by kind, type, assembly and search, without any outside script."""
    shown = V.sample(graph, most)
    nodes, links = ([r.asDict() for r in df.collect()] for df in (V.view_nodes(shown.nodes), V.view_links(shown.edges)))
    title = escape_html(graph.meta.solution_name or graph.meta.solution)
    data = json.dumps({"nodes": nodes, "links": links}, ensure_ascii=False).replace("</", "<\\/")
    kinds, types, assemblies = (sorted({x[k] for x in rows if x[k]}) for rows, k in ((nodes, "kind"), (links, "type"), (nodes, "assembly")))
    boxes = lambda name, values: "".join(f'<label><input type="checkbox" name="{name}" value="{escape_html(v)}" checked>{escape_html(v)}</label>' for v in values)
    options = "".join(f"<option>{escape_html(a)}</option>" for a in assemblies)
    return f"""<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Graph of {title}</title>
<style>body{{font:14px sans-serif;margin:1em}}label{{margin-right:1em}}#list{{columns:2}}</style></head>
<body><h1>{title}</h1><p>{len(nodes)} nodes, {len(links)} links</p>
<form>{boxes("kind", kinds)}<br>{boxes("type", types)}<br><select name="assembly"><option></option>{options}</select> <input name="search" placeholder="search"></form>
<ul id="list"></ul>
<script>
const data = {data};
const form = document.querySelector('form');
function show() {{
  const on = n => new Set([...form.querySelectorAll(`[name=${{n}}]:checked`)].map(b => b.value));
  const kinds = on('kind'), types = on('type'), assembly = form.assembly.value, search = form.search.value.toLowerCase();
  const seen = data.nodes.filter(n => kinds.has(n.kind) && (!assembly || n.assembly === assembly) && (n.name + ' ' + n.id).toLowerCase().includes(search));
  const hidden = new Set(data.nodes.map(n => n.id)); seen.forEach(n => hidden.delete(n.id));
  const out = {{}};
  data.links.filter(l => types.has(l.type) && !hidden.has(l.source) && !hidden.has(l.target)).forEach(l => (out[l.source] ??= []).push(l.type + ' ' + l.target));
  document.querySelector('#list').replaceChildren(...seen.map(n => {{
    const item = document.createElement('li'); item.textContent = n.kind + ' ' + n.id; item.title = (out[n.id] || []).join('\\n'); return item;
  }}));
}}
form.addEventListener('input', show); show();
</script></body></html>
"""
