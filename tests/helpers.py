from arcwright.model import EDGES, NODES, Graph, Metadata

_N = [c.split(" ")[0] for c in NODES.split(", ")]
_E = [c.split(" ")[0] for c in EDGES.split(", ")]


def node(id, kind="method", **more):
    base = {"id": id, "name": id.rpartition(".")[2], "kind": kind, "file_path": "", "start_line": 0, "end_line": 0, "signature": "", "doc_comment": None, "containing_type_id": None, "containing_namespace_id": None, "accessibility": "public", "assembly_name": "", "metadata": {}}
    return base | more


def edge(a, b, type="calls", **more):
    base = {"from_id": a, "to_id": b, "type": type, "is_external": False, "package_source": None, "source_link": None, "resolution": None, "metadata": {}}
    return base | more


def graph(spark, nodes, edges, meta=Metadata()):
    n = [tuple(x[c] for c in _N) + (i,) for i, x in enumerate(nodes)]
    e = [tuple(x[c] for c in _E) + (i,) for i, x in enumerate(edges)]
    return Graph(spark.createDataFrame(n, NODES + ", ord bigint"), spark.createDataFrame(e, EDGES + ", ord bigint"), meta)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def pairs(df):
    return sorted((r["from_id"], r["to_id"], r["type"]) for r in df.collect())


def orders(spark):
    """Services that place orders, a controller that calls them, a test and a registration."""
    s = "MyApp.Services"
    nodes = [
        node(f"{s}.OrderService", "type", containing_namespace_id=s, doc_comment="Places orders", signature="class OrderService", file_path="OrderService.cs", start_line=1, end_line=90),
        node(f"{s}.OrderService.PlaceOrder", containing_namespace_id=s, doc_comment="Places one", signature="void PlaceOrder()", file_path="OrderService.cs", start_line=10, end_line=20),
        node(f"{s}.InventoryService.Reserve", containing_namespace_id=s),
        node("MyApp.Controllers.OrderController.Post", containing_namespace_id="MyApp.Controllers"),
        node("MyApp.Tests.OrderServiceTests.PlaceOrder_Succeeds", containing_namespace_id="MyApp.Tests"),
        node("MyApp.Data.SqlOrderRepository", "type", containing_namespace_id="MyApp.Data"),
        node(s, "namespace"),
    ]
    place = f"{s}.OrderService.PlaceOrder"
    edges = [
        edge(place, f"{s}.InventoryService.Reserve"), edge("MyApp.Controllers.OrderController.Post", place), edge("MyApp.Tests.OrderServiceTests.PlaceOrder_Succeeds", place, "covers"),
        edge(f"{s}.OrderService", place, "contains"), edge(place, "MyApp.Data.SqlOrderRepository", "resolvesTo", resolution="IOrderRepository → SqlOrderRepository (registered: Scoped)"),
    ]
    return graph(spark, nodes, edges, Metadata(commit_hash="a1b2c3d4e5f6", branch="main", generated_at="2026-04-14T12:00:00+00:00"))
