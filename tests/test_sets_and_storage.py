import json

import pytest
from helpers import edge, graph, ids, node, orders, pairs

from arcwright.model import GraphError, Metadata, SplitBy
from arcwright.operators import sets, split, views
from arcwright.plans import render
from arcwright.sources import config, graph_dir


def test_diff(spark):
    base = graph(spark, [node("A", signature="A()"), node("B", signature="B()")], [edge("A", "B"), edge("B", "A", "references")])
    head = graph(spark, [node("A", signature="A(int x)"), node("C", "type", signature="class C")], [edge("A", "C"), edge("B", "A", "references"), edge("B", "A", "references")])
    d = sets.diff(base, head)
    assert ids(d.added_nodes) == ["C"] and ids(d.removed_nodes) == ["B"] and ids(d.signature_changed) == ["A"]
    assert pairs(d.added_edges) == [("A", "C", "calls")] and pairs(d.removed_edges) == [("A", "B", "calls")]
    some = sets.only(d, sets.parse_changes("added, Signature-Changed"))
    assert some.removed_nodes.isEmpty() and not some.added_edges.isEmpty() and some.removed_edges.isEmpty()
    assert {r["change"]: r["n"] for r in sets.diff_counts(d).collect()} == {"added-nodes": 1, "removed-nodes": 1, "signature-changed": 1, "added-edges": 1, "removed-edges": 1}
    with pytest.raises(GraphError):
        sets.parse_changes("everything")
    assert render.diff_text(d) == "Graph Diff unknown..unknown\nAdded nodes: 1\nRemoved nodes: 1\nSignature changes: 1\nAdded edges: 1\nRemoved edges: 1"
    assert "## Changed Signatures (1)\n- A\n  - Was: A()\n  + Now: A(int x)" in render.diff_context(d) and "- A → C (Calls)" in render.diff_context(d)
    assert json.loads(render.diff_json(some))["removedNodes"] == []


def test_merge(spark):
    old = graph(spark, [node("ProjectA.ClassA", "type"), node("ProjectA.ClassA.OldMethod"), node("ProjectB.ClassB", "type")], [edge("ProjectA.ClassA", "ProjectA.ClassA.OldMethod", "contains"), edge("ProjectB.ClassB", "ProjectA.ClassA")])
    new = graph(spark, [node("ProjectA.ClassA", "type"), node("ProjectA.ClassA.NewMethod")], [edge("ProjectA.ClassA", "ProjectA.ClassA.NewMethod", "contains")])
    m = sets.merge(old, new, ["ProjectA"])
    assert ids(m.nodes) == ["ProjectA.ClassA", "ProjectA.ClassA.NewMethod", "ProjectB.ClassB"]
    assert pairs(m.edges) == [("ProjectA.ClassA", "ProjectA.ClassA.NewMethod", "contains"), ("ProjectB.ClassB", "ProjectA.ClassA", "calls")]
    lone = sets.merge(graph(spark, [node("Lone")], []), graph(spark, [], []), ["Lone"])
    assert ids(lone.nodes) == []


@pytest.mark.parametrize("by, names", [(SplitBy.PROJECT, ["MyApp", "System"]), (SplitBy.NAMESPACE, ["MyApp.A", "MyApp.B", "System"]), (SplitBy.ASSEMBLY, ["Core", "MyApp", "_external"])])
def test_split(spark, by, names):
    nodes = [node("MyApp.A.X", "type", assembly_name="Core", file_path="x.cs"), node("MyApp.B.Y", "type", file_path="y.cs"), node("System.Text", "type", metadata={"assembly": "System"})]
    g = graph(spark, nodes, [edge("MyApp.A.X", "System.Text"), edge("unknown", "MyApp.B.Y")])
    grouped = split.group_nodes(g.nodes, by)
    assert sorted({r["group"] for r in grouped.collect()}) == names
    assert {r["from_id"]: r["group"] for r in split.group_edges(g.edges, grouped).collect()}["unknown"] == {SplitBy.PROJECT: "MyApp", SplitBy.NAMESPACE: "MyApp.A", SplitBy.ASSEMBLY: "Core"}[by]
    assert len(split.group_edges(g.edges, grouped, drop_unknown=True).collect()) == 1
    outside = graph(spark, [node("E", "type", file_path="e.cs", metadata={"assembly": "Z"})], [])
    assert split.group_nodes(outside.nodes).first()["group"] == "E"


def test_round_trip_and_federation(spark, tmp_path):
    g = orders(spark)
    graph_dir.write_graph(g, tmp_path / "one")
    back = graph_dir.read_graph(spark, tmp_path / "one")
    assert ids(back.nodes) == ids(g.nodes) and pairs(back.edges) == pairs(g.edges) and back.meta == g.meta
    assert back.nodes.where("name = 'PlaceOrder'").first()["doc_comment"] == "Places one"
    stored = json.loads((tmp_path / "one" / "MyApp.json").read_text())
    assert stored["projectOrNamespace"] == "MyApp" and stored["edges"][0]["packageSource"] is None
    for name, more in (("backend", "B"), ("frontend", "F")):
        shared = [node("Shared.Core.Logger", "type", signature=name), node(f"{more}.Only", "type"), node("System.X", "type", metadata={"assembly": "System"})]
        graph_dir.write_graph(graph(spark, shared, [edge(f"{more}.Only", "Shared.Core.Logger"), edge("Shared.Core.Logger", "System.X")], Metadata(solution_name=name, projects_indexed=("Shared", more))), tmp_path / "many" / name)
    both = graph_dir.load(spark, tmp_path / "many")
    assert ids(both.nodes) == ["B.Only", "F.Only", "Shared.Core.Logger", "System.X"] and len(pairs(both.edges)) == 3
    assert both.nodes.where("name = 'Logger'").first()["signature"] == "backend"
    assert both.meta.solution_name == "backend, frontend" and both.meta.projects_indexed == ("Shared", "B", "F")
    assert ids(graph_dir.load(spark, tmp_path / "many", "FRONTEND").nodes) == ["F.Only", "Shared.Core.Logger", "System.X"]
    for bad in (tmp_path / "none", tmp_path / "one" / "none"):
        with pytest.raises(FileNotFoundError):
            graph_dir.load(spark, bad)
    with pytest.raises(FileNotFoundError):
        graph_dir.load(spark, tmp_path / "many", "other")
    (tmp_path / "one" / "meta.json").write_text('{"schemaVersion": 9}')
    with pytest.raises(GraphError):
        graph_dir.read_graph(spark, tmp_path / "one")


def test_sample_and_facets(spark):
    nodes = [node(f"T.Class{i}", "type" if i % 2 == 0 else "method") for i in range(10)]
    g = graph(spark, nodes, [edge(f"T.Class{i}", f"T.Class{i + 1}") for i in range(9)] + [edge("T.Class1", "gone"), edge("T.Class3", "T.Class3")])
    assert len(pairs(views.sample(g, 10).edges)) == 11
    s = views.sample(g, 7)
    assert ids(s.nodes) == ["T.Class0", "T.Class1", "T.Class2", "T.Class3", "T.Class4", "T.Class6", "T.Class8"]
    assert ids(views.sample(g, 3).nodes) == ["T.Class0", "T.Class1", "T.Class2"]
    assert views.stats(g.nodes, g.edges).first().asDict() == {"node_count": 10, "edge_count": 11, "type_count": 5, "method_count": 5}
    assert {r["id"]: r["degree"] for r in views.degrees(g.edges).collect()}["T.Class3"] == 4


def test_config(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    config.save_config(config.Config(solutions=["x/One.sln", "Two.slnx"]), tmp_path / config.FILE)
    assert config.load_config(start=tmp_path / "a" / "b").effective_solutions() == ["x/One.sln", "Two.slnx"]
    assert config.Config(solution="S.sln").effective_solutions() == ["S.sln"] and config.Config().effective_solutions() == []
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.json")
    for text in ("{", '{"solution": "a.sln", "solutions": ["b.sln"]}', '{"solutions": ["a/X.sln", "b/x.slnx"]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(GraphError):
            config.load_config(tmp_path / "bad.json")
    (tmp_path / "bin").mkdir()
    for f in ("One.sln", "bin/Two.sln", "a/Three.slnx"):
        (tmp_path / f).write_text("")
    assert config.find_solutions(tmp_path) == ["One.sln", "a/Three.slnx"]
    assert config.stale(tmp_path, tmp_path) is None
