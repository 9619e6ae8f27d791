import random

import pytest
from helpers import edge, graph, ids, node, orders, pairs

from arcwright.functions.text import parse_edge_type, parse_kind_prefix, wildcard
from arcwright.model import GraphError, QueryOptions
from arcwright.operators import match, rank, traverse
from arcwright.operators.subgraph import query
from arcwright.plans import render


def test_patterns():
    assert parse_kind_prefix("Type:A:b") == ("type", "A:b") and parse_kind_prefix("foo:A") == (None, "foo:A") and parse_kind_prefix("type:") == (None, "type:")
    assert parse_edge_type("CALLS-from") == "calls" and parse_edge_type("dependsON") == "dependsOn" and parse_edge_type("3") == "implements" and parse_edge_type("all") is None and parse_edge_type(" ") is None
    with pytest.raises(GraphError):
        parse_edge_type("nonsense")
    assert wildcard("a.b*?") == r"(?iud)^a\.b.*\?$" and wildcard("a?", True) == "(?iud)^a.$"


def test_matching(spark):
    g = orders(spark)
    assert ids(match.match(g.nodes, "placeorder")) == ["MyApp.Services.OrderService.PlaceOrder"]
    assert ids(match.match(g.nodes, "Order_Succeeds")) == ["MyApp.Tests.OrderServiceTests.PlaceOrder_Succeeds"]  # partial
    assert ids(match.match(g.nodes, "type:PlaceOrder")) == []  # the kind doesn't bring partial matches back
    assert len(ids(match.match(g.nodes, "*order*"))) == 5
    assert ids(match.match(g.nodes, "TYPE:*Order*")) == ["MyApp.Data.SqlOrderRepository", "MyApp.Services.OrderService"]
    assert len(ids(match.match(g.nodes, "  "))) == 7
    assert ids(match.in_namespace(g.nodes, "myapp.da*")) == ["MyApp.Data.SqlOrderRepository"]
    assert ids(match.in_project(g.nodes, "MYAPP.TESTS")) == ["MyApp.Tests.OrderServiceTests.PlaceOrder_Succeeds"]


def test_queries(spark):
    g = orders(spark)
    place = "MyApp.Services.OrderService.PlaceOrder"
    r = query(g, QueryOptions("PlaceOrder", 0))
    assert ids(r.nodes) == [place] and r.match_count == 1 and not r.truncated and r.edges.isEmpty()
    r = query(g, QueryOptions("PlaceOrder", 1))
    assert len(ids(r.nodes)) == 6 and len(pairs(r.edges)) == 5
    r = query(g, QueryOptions("PlaceOrder", 1, edge_type="calls"))
    assert len(ids(r.nodes)) == 6 and {t for *_, t in pairs(r.edges)} == {"calls"}
    for ranked in (True, False):
        r = query(g, QueryOptions("PlaceOrder", 1, max_nodes=2, rank=ranked))
        assert r.truncated and place in ids(r.nodes) and len(ids(r.nodes)) <= 3
        kept = set(ids(r.nodes))
        assert all(a in kept and b in kept for a, b, _ in pairs(r.edges))
    assert not query(g, QueryOptions("PlaceOrder", 1, max_nodes=6)).truncated
    assert query(g, QueryOptions("Nothing")).match_count == 0


def test_external_edges(spark):
    g = graph(spark, [node("A"), node("Ext")], [edge("A", "Ext", is_external=True)])
    assert ids(query(g, QueryOptions("A")).nodes) == ["A"]
    r = query(g, QueryOptions("A", include_external=True))
    assert ids(r.nodes) == ["A", "Ext"] and len(pairs(r.edges)) == 1


def test_direct_neighbours_come_first(spark):
    g = graph(spark, [node(x) for x in ("S", "D1", "D2", "T1")], [edge("S", "D1"), edge("S", "D2"), edge("D1", "T1")])
    assert ids(query(g, QueryOptions("S", 2, max_nodes=3)).nodes) == ["D1", "D2", "S"]


@pytest.mark.parametrize(
    "better, worse",
    [({"id": "zz"}, {"id": "aa", "kind": "namespace"}), ({"id": "zz", "doc_comment": ""}, {"id": "aa"}), ({"id": "P.z"}, {"id": "A.a"}), ({"id": "a"}, {"id": "B"}), ({"id": "zz", "kind": "property"}, {"id": "aa", "kind": "type"})],
)
def test_ranking(spark, better, worse):
    g = graph(spark, [node(**worse), node(**better)], [])
    none = g.nodes.select("id").limit(0)
    assert rank.rank(g.nodes, none, none, "P").first()["id"] == better["id"]


def _walk(seeds, edges, depth, external):
    reached = {s: 0 for s in seeds}
    frontier = set(seeds)
    for d in range(1, depth + 1):
        step = {b for e in edges if external or not e["is_external"] for a, b in ((e["from_id"], e["to_id"]), (e["to_id"], e["from_id"])) if a in frontier}
        frontier = {x for x in step if x not in reached}
        reached |= {x: d for x in frontier}
    return reached


@pytest.mark.parametrize("seed", range(3))
def test_traversal_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)] + ["gone1", "gone2"]
    edges = [edge(rng.choice(names), rng.choice(names), is_external=rng.random() < 0.2) for _ in range(40)]
    edges += edges[:3] + [edge("n1", "n1")]
    g = graph(spark, [node(n) for n in names[:25]], edges)
    seeds = g.nodes.where("id in ('n0', 'n7')")
    seeds = seeds.unionByName(seeds)
    for depth, external in ((0, False), (1, True), (3, False)):
        found = {r["id"]: r["depth"] for r in traverse.traverse(seeds, g.edges, depth, external).collect()}
        assert found == _walk(["n0", "n7"], edges, depth, external)


def test_rendering(spark):
    g = orders(spark)
    r = query(g, QueryOptions("PlaceOrder", 1))
    text = render.context(r, "PlaceOrder --depth 1 --kind all")
    assert text.startswith("# Subgraph for MyApp.Services.OrderService.PlaceOrder\n## Commit: a1b2c3d (main, 2026-04-14)\n## Query: PlaceOrder --depth 1 --kind all\n\n### Target\n- MyApp.Services.OrderService.PlaceOrder\n  File: OrderService.cs:10-20\n  Sig:  void PlaceOrder()\n  Doc:  Places one\n")
    assert "### Calls (outgoing)\n- MyApp.Services.InventoryService.Reserve" in text and "### Called by (incoming)" in text and "### Covers\n" in text and "  Resolution: IOrderRepository" in text
    assert "Calls (2):\n  Post -> PlaceOrder\n  PlaceOrder -> Reserve" in render.text(r)
    import json

    assert json.loads(render.as_json(r))["totalMatchCount"] == 1
    many = query(g, QueryOptions("*Order*", 1, max_nodes=1))
    assert "### Matched Nodes (5)" in render.context(many) and render.text(many).endswith("Showing subset of 5 total matches.")
    assert "<title>Graph of" in render.page(g) and "PlaceOrder" in render.page(g, 3)
