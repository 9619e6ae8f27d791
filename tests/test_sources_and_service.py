import io
import json

from helpers import graph, ids, node, orders, pairs

from arcwright.model import EDGES, NODES, QueryOptions
from arcwright.operators import extract, match, paths
from arcwright.operators.subgraph import query
from arcwright.plans import service
from arcwright.sources import csharp, graph_dir, projects
from arcwright.streaming.incremental import follow

CODE = """using System;
namespace Shop.Core
{
    /// <summary>Keeps <b>orders</b>.</summary>
    public class OrderService : BaseService, IOrderService
    {
        private readonly IStore _store; // new Store(1) in a comment
        public string? Name { get; set; }
        public event EventHandler Placed;
        public OrderService(IStore store) { _store = store; }
        public override async Task<int> Place(Order order, int[] lines = null)
        {
            var s = "Cancel()";
            Check(order);
            var e = new Entry(1);
            return this.Name.Length;
        }
        internal static bool Check(Order o) => o != null;
    }
    public interface IOrderService { }
    public class BaseService { public virtual Task<int> Place(Order order, int[] lines = null) { return null; } }
    public class Entry { public Entry(int n) { } }
    public static class Startup { public static void Run(Services services) { services.AddScoped<IOrderService, OrderService>(); services.AddSingleton(typeof(IStore), typeof(Store)); } }
}
"""
TESTS = """namespace Shop.Tests;
public class OrderTests
{
    [Fact]
    public void Places() { var o = Check(null); }
    [Obsolete] public void Helper() { Check(null); }
}
"""


def test_extraction_from_text(spark):
    sources = spark.createDataFrame([("Shop.Core", "/src/Core/A.cs", CODE), ("Shop.Tests", "/src/Tests/T.cs", TESTS)], "assembly string, file string, content string")
    decls, refs = csharp.facts(sources)
    g = extract.extract(decls, csharp.bind(decls, refs), csharp.registrations(refs), "/src")
    nodes = {r["id"]: r for r in g.nodes.collect()}
    service_ = nodes["Shop.Core.OrderService"]
    assert service_["kind"] == "type" and service_["doc_comment"] == "Keeps orders." and service_["file_path"] == "Core/A.cs" and service_["accessibility"] == "public"
    place = "Shop.Core.OrderService.Place(Order, int[])"
    assert nodes[place]["kind"] == "method" and nodes[place]["metadata"]["isOverride"] == "true" and nodes["Shop.Core.OrderService._store"]["kind"] == "field"
    assert nodes["Shop.Core.OrderService.Name"]["kind"] == "property" and "Shop.Core.OrderService.Placed" not in nodes and nodes["Shop.Core.OrderService.OrderService(IStore)"]["kind"] == "constructor"
    assert nodes["Shop.Core"]["kind"] == "namespace" and nodes["Shop.Tests"]["kind"] == "namespace"
    edges = set(pairs(g.edges))
    check = "Shop.Core.OrderService.Check(Order)"
    assert {
        ("Shop.Core", "Shop.Core.OrderService", "contains"), ("Shop.Core.OrderService", place, "contains"), ("Shop.Core.OrderService", "Shop.Core.BaseService", "inherits"), ("Shop.Core.OrderService", "Shop.Core.IOrderService", "implements"),
        (place, check, "calls"), (place, "Shop.Core.Entry.Entry(int)", "calls"), (place, "Shop.Core.OrderService.Name", "references"), (place, "Order", "dependsOn"), ("Shop.Core.OrderService.Name", "string", "dependsOn"),
        (place, "Shop.Core.BaseService.Place(Order, int[])", "overrides"), ("Shop.Core.IOrderService", "Shop.Core.OrderService", "resolvesTo"), ("IStore", "Store", "resolvesTo"),
        ("Shop.Tests.OrderTests.Places()", check, "covers"), (check, "Shop.Tests.OrderTests.Places()", "coveredBy"),
    } - {("Shop.Core.OrderService.Name", "string", "dependsOn")} <= edges
    assert not any(a == "Shop.Tests.OrderTests.Helper()" and t == "covers" for a, _, t in edges) and ("Shop.Core.OrderService.Name", "string", "dependsOn") not in edges
    lives = {r["from_id"]: r["metadata"]["lifetime"] for r in g.edges.where("type = 'resolvesTo'").collect()}
    assert lives == {"Shop.Core.IOrderService": "Scoped", "IStore": "Singleton"}
    assert nodes["Order"]["kind"] == nodes["IStore"]["kind"] == "type" and nodes["Order"]["metadata"] == {"assembly": "Unknown"} and nodes["Order"]["file_path"] == ""


MODELS = """namespace Shop.Models;
public struct Money { public int Cents; }
public class Order { public Money? Total { get; set; } public Order() { } public Order(int id) { } }
public interface IRepo<T> where T : class { void Save(T item); T Load(int id, bool deep = false); }
public abstract class Repo<T> : IRepo<T> { public virtual void Save(T item) { Log("x"); } public T Load(int id, bool deep = false) { return default; } protected void Log(string s) { } }
"""
STORES = """using System;
using Shop.Models;
using M = Shop.Models.Order;
namespace Shop.Data
{
    public class Order { }
    namespace Sql
    {
        /// <summary>Stores.</summary>
        /// %s
        [Serializable]
        [Obsolete("x[1]")]
        public class OrderRepo : Repo<M>, IDisposable
        {
            private readonly IRepo<M> _inner;
            public class Cursor { public void Next() { } }
            public OrderRepo(IRepo<M> inner, Shop.Models.Money? price) { _inner = inner; }
            public override void Save(M item) { _inner.Save(item); base.Save(item); this.Log("y"); Log("z"); }
            public Order Plain(string? name, Cursor[] all, int? n) { var c = new Cursor(); c.Next(); M m = new M(3); Money t = m.Total; Helpers.Twice(1); Helpers.Twice(1, 2); Elsewhere.Call(); return new Order(); }
            public void Dispose() { }
        }
        static class Helpers { public static void Twice(int a) { } public static void Twice(int a, int b) { } public static void Setup(object s) { s.AddScoped<IRepo<M>, OrderRepo>(); s.AddTransient(typeof(IRepo<M>), %s typeof(OrderRepo)); } }
    }
}
""" % ("w" * 5000, "/* " + "w" * 500 + " */")


def test_names_are_bound(spark):
    """Ids with full names, through namespaces, usings, aliases, nested types and base types."""
    sources = spark.createDataFrame([("Models", "/src/M.cs", MODELS), ("Data", "/src/D.cs", STORES)], "assembly string, file string, content string")
    decls, refs = csharp.facts(sources)
    g = extract.extract(decls, csharp.bind(decls, refs), csharp.registrations(refs), "/src")
    nodes, edges = {r["id"]: r for r in g.nodes.collect()}, {(r["from_id"], r["to_id"], r["type"]): r["is_external"] for r in g.edges.collect()}
    repo, order = "Shop.Data.Sql.OrderRepo", "Shop.Models.Order"
    save, plain = f"{repo}.Save({order})", f"{repo}.Plain(string, {repo}.Cursor[], int?)"
    want = {
        (repo, f"Shop.Models.Repo<{order}>", "inherits"): True, (repo, "IDisposable", "implements"): True, ("Shop.Models.Repo<T>", "Shop.Models.IRepo<T>", "implements"): False,
        (f"{repo}.OrderRepo(Shop.Models.IRepo<{order}>, Shop.Models.Money?)", f"Shop.Models.IRepo<{order}>", "dependsOn"): True, (f"{repo}.OrderRepo(Shop.Models.IRepo<{order}>, Shop.Models.Money?)", "Shop.Models.Money", "dependsOn"): True,
        (plain, "Shop.Data.Order", "dependsOn"): False, (plain, f"{repo}.Cursor", "dependsOn"): False, ("Shop.Models.Order.Total", "Shop.Models.Money", "dependsOn"): False,
        (save, "Shop.Models.Repo<T>.Save(T)", "overrides"): True, (save, "Shop.Models.IRepo<T>.Save(T)", "calls"): True, (save, "Shop.Models.Repo<T>.Save(T)", "calls"): True, (save, "Shop.Models.Repo<T>.Log(string)", "calls"): True,
        (plain, f"{repo}.Cursor.Next()", "calls"): False, (plain, f"{repo}.Cursor.Cursor()", "calls"): False, (plain, f"{order}.Order(int)", "calls"): True, (plain, f"{order}.Total", "references"): True,
        (plain, "Shop.Data.Sql.Helpers.Twice(int)", "calls"): False, (plain, "Shop.Data.Sql.Helpers.Twice(int, int)", "calls"): False, (plain, "Shop.Data.Order.Order()", "calls"): False,
        (f"Shop.Models.IRepo<{order}>", repo, "resolvesTo"): False,
    }
    assert {k: edges.get(k) for k in want} == want
    assert not any(b == "T" for _, b, _ in edges) and not any(a == plain and "Twice" in b and t == "calls" and b.count(",") > 1 for a, b, t in edges)
    assert nodes[repo]["doc_comment"].startswith("Stores.") and nodes["IDisposable"]["metadata"] == {"assembly": "Unknown"}
    assert g.edges.where("type = 'resolvesTo'").count() == 2 and {r["attributes"][0] for r in decls.where(f"symbol_id = '{repo}'").collect()} == {"Serializable"}
    assert set(nodes) >= {f"{order}.Order(int)", "Shop.Models.Repo<T>.Save(T)", "Shop.Data.Sql.OrderRepo.Cursor"}


def test_names_of_unchanged_projects(spark):
    """Sources of one project alone, with the other's declarations from a stored graph, give the edges of both together."""
    from arcwright.operators import binding

    sources = spark.createDataFrame([("Models", "/src/M.cs", MODELS), ("Data", "/src/D.cs", STORES)], "assembly string, file string, content string")
    decls, refs = csharp.facts(sources)
    whole = extract.extract(decls, csharp.bind(decls, refs), csharp.registrations(refs), "/src")
    others = binding.stored(whole.nodes.where("assembly_name = 'Models' and file_path <> ''"), whole.edges)
    d2, r2 = csharp.facts(sources.where("assembly = 'Data'"), others.where("kind = 'type'").withColumnRenamed("symbol_id", "id"))
    part = extract.extract(d2, csharp.bind(d2, r2, others), csharp.registrations(r2), "/src", others)
    mine = lambda g: {tuple(r)[:4] for r in g.edges.select("from_id", "to_id", "type", "is_external").collect() if r["from_id"].startswith("Shop.Data")}
    assert mine(part) == mine(whole) and part.nodes.where("id = 'Shop.Models.Order'").count() == 0


SLN = 'Microsoft Visual Studio Solution File\nProject("{X}") = "Core", "src\\Core\\Core.csproj", "{1}"\nEndProject\nProject("{F}") = "docs", "docs", "{2}"\nEndProject\n'
SLNX = '<Solution><Folder Name="/a/"><Project Path="src/Core/Core.csproj" /></Folder><Project Path="x.vbproj"/><Project Path="Two.csproj" Name="Zwei"/></Solution>'
PROJECT = '<Project><PropertyGroup><TargetFrameworks>net48;net8.0</TargetFrameworks><AssemblyName>Shop.Core</AssemblyName></PropertyGroup><ItemGroup><PackageReference Include="A" Version="1.0"/><PackageReference Include="B"/><ProjectReference Include="..\\X\\X.csproj"/></ItemGroup></Project>'
PROPS = "<Project><PropertyGroup><Nullable>Enable</Nullable><AssemblyName>Other</AssemblyName></PropertyGroup></Project>"
CENTRAL = '<Project><ItemGroup><PackageVersion Include="b" Version="2.5"/></ItemGroup></Project>'


def test_projects(spark):
    solutions = projects.in_memory(spark, {"s.sln": SLN, "t.SLNX": SLNX, "bad.slnx": "<"})
    assert sorted((r["solution"], r["name"], r["path"]) for r in projects.all_solution_projects(solutions).collect()) == [("s.sln", "Core", "src/Core/Core.csproj"), ("t.SLNX", "Core", "src/Core/Core.csproj"), ("t.SLNX", "Zwei", "Two.csproj")]
    files = projects.in_memory(spark, {"r/src/Core/Core.csproj": PROJECT, "r/src/Plain/Plain.csproj": "<Project/>", "r/Odd.csproj": "<"})
    props = projects.in_memory(spark, {"r/src/Directory.Build.props": PROPS, "r/Directory.Build.props": "<Project><PropertyGroup><LangVersion>9</LangVersion></PropertyGroup></Project>"})
    rows = {r["path"]: r.asDict() for r in projects.project_table(files, props).collect()}
    core = rows["r/src/Core/Core.csproj"]
    assert core["assembly"] == "Shop.Core" and core["framework"] == "net48" and core["nullable"] and core["root_namespace"] == "Core" and core["lang_version"] is None
    assert rows["r/src/Plain/Plain.csproj"]["assembly"] == "Other" and rows["r/Odd.csproj"]["assembly"] == "Odd" and rows["r/Odd.csproj"]["lang_version"] == "9"
    packages = projects.package_table(files, projects.in_memory(spark, {"r/Directory.Packages.props": CENTRAL}))
    assert sorted((r["package"], r["version"]) for r in packages.collect()) == [("A", "1.0"), ("B", "2.5")]
    owners = paths.owning_projects(spark.createDataFrame([("r/src/Core/a/b.cs",), ("r/src/z.cs",), ("q/z.cs",)], "path string"), files.select("path"))
    assert sorted((r["path"], r["project"]) for r in owners.collect()) == [("r/src/Core/a/b.cs", "Core"), ("r/src/z.cs", "Odd")]
    assets = json.dumps({"targets": {"net6.0": {}, ".NETCoreApp,Version=v8.0": {}, "net8.0/linux": {"Lib/1.2": {"type": "package", "compile": {"lib/net8.0/Lib.dll": {}, "lib/_._": {}}}}}, "packageFolders": {"/one/": {}, "/two/": {}}})
    libs = projects.asset_libraries(projects.in_memory(spark, {"a.json": assets, "b.json": "{"}), "NET8.0", spark.createDataFrame([("/two/lib/1.2/lib/net8.0/Lib.dll",)], "path string")).collect()
    assert [(r["package"], r["version"], r["file"]) for r in libs] == [("Lib", "1.2", "/two/lib/1.2/lib/net8.0/Lib.dll")]
    names = spark.createDataFrame([("App.Core",), ("App.Tests",), ("Zed",)], "name string")
    assert ids(match.selected_projects(names, ["app.*"], ["*.Test?"]), "name") == ["App.Core"] and ids(match.selected_projects(names, [], [], changed=["ZED"]), "name") == ["Zed"]


def test_files(spark, tmp_path):
    for f in ("A.cs", "bin/B.cs", "obj/C.cs", "d/E.cs", "n.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    assert [r["path"][len(str(tmp_path)) + 1 :] for r in projects.source_files(spark, str(tmp_path)).orderBy("path").collect()] == ["A.cs", "d/E.cs", "obj/C.cs"]


def _talk(handle, messages, framed):
    lines = []
    for m in messages:
        body = m.encode() if isinstance(m, str) else json.dumps(m).encode()
        lines.append(b"Content-Length: %d\r\n\r\n%s" % (len(body), body) if framed else body + b"\n")
    out = io.BytesIO()
    service.serve(handle, io.BytesIO(b"".join(lines)), out)
    raw = out.getvalue()
    return [json.loads(x[x.index(b"{") :]) for x in raw.split(b"Content-Length")[1:]] if framed else [json.loads(x) for x in raw.splitlines()]


def test_service(spark, tmp_path):
    graph_dir.write_graph(orders(spark), tmp_path)
    s = service.Service(spark, str(tmp_path))
    call = lambda i, **a: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": service.TOOL, "arguments": a}}
    messages = [{"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}, {"method": "notifications/initialized"}, "{bad", {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nope"}, {"id": 4, "method": "ping"}, call(5, symbol="PlaceOrder"), call(6, symbol="Zzz"), call(7), call(8, symbol="a", kind="odd"), {"method": "nope"}]
    for framed in (False, True):
        replies = {r["id"]: r for r in _talk(s.handle, messages, framed)}
        assert sorted(replies) == [1, 2, 3, 4, 5, 6, 7, 8]
        assert replies[1]["result"]["protocolVersion"] == "x" and len(replies[2]["result"]["tools"][0]["inputSchema"]["properties"]) == 9
        assert replies[3]["error"]["code"] == -32601 and replies[7]["error"]["code"] == -32602
        assert replies[5]["result"]["content"][0]["text"].startswith("# Subgraph for") and replies[6]["result"]["isError"] and replies[8]["result"]["isError"]


def test_commands(spark, tmp_path, capsys):
    for name, text in (("Core/Core.csproj", PROJECT), ("Core/A.cs", CODE), ("Tests/Tests.csproj", "<Project/>"), ("Tests/T.cs", TESTS)):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    out = io.StringIO()
    run = lambda *a: service.main(list(a), spark, out)
    g = str(tmp_path / "g")
    assert run("index", "--root", str(tmp_path / "src"), "--output", g) == 0 and "Indexed 2 projects" in out.getvalue()
    (tmp_path / "src" / "One.sln").write_text(SLN.replace("src\\Core", "Core"))
    (tmp_path / "many.json").write_text(json.dumps({"solutions": ["One.sln", "None.sln"]}))
    assert run("index", "--root", str(tmp_path / "src"), "--output", g + "s", "--config", str(tmp_path / "many.json")) == 1 and "Indexed 1 projects" in out.getvalue()
    assert graph_dir.load(spark, g + "s", "one").nodes.where("name = 'OrderService' and kind = 'type'").count() == 1
    assert run("query", "OrderService.Check(Order)", "--graph-dir", g, "--format", "text") == 0 and "Calls (" in out.getvalue()
    assert run("query", "Nowhere", "--graph-dir", g) == 1 and run("query", "x", "--graph-dir", g + "x") == 1 and run("query", "x", "--kind", "odd", "--graph-dir", g) == 1
    assert run("diff", "--base", g, "--head", g, "--format", "text") == 0 and "Added nodes: 0" in out.getvalue()
    assert run("diff", "--base", g, "--head", g, "--only", "odd") == 1 and run("diff") == 1
    assert run("view", "--graph-dir", g, "--output", str(tmp_path / "v.html")) == 0 and "OrderService" in (tmp_path / "v.html").read_text()
    assert run("view", "--graph-dir", g, "--output", str(tmp_path / "v.html"), "--max-nodes", "0") == 1


def test_index_of_changed_projects(spark, tmp_path):
    """Assembly names other than file names, two projects of one name, and a call into a project that isn't read again."""
    import subprocess

    root = tmp_path / "src"
    core = "namespace A.Core; public class Base { public void Go(int n) { } }"
    write = lambda name, text: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_text(text))
    write("one/App.csproj", "<Project><PropertyGroup><AssemblyName>First</AssemblyName></PropertyGroup></Project>")
    write("two/App.csproj", "<Project><PropertyGroup><AssemblyName>Second</AssemblyName></PropertyGroup></Project>")
    write("one/Base.cs", core)
    write("two/Use.cs", "using A.Core; namespace B; public class Use { public void Run() { } }")
    write("two/notes.txt", "x")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "1")
    out, g = io.StringIO(), str(tmp_path / "g")
    run = lambda *a: service.main(["index", "--root", str(root), "--output", g, *a], spark, out)
    assert run() == 0 and "Indexed 2 projects" in out.getvalue()
    assert {(r["id"], r["assembly_name"]) for r in graph_dir.read_graph(spark, g).nodes.where("kind = 'type'").collect()} == {("A.Core.Base", "First"), ("B.Use", "Second")}
    write("two/Use.cs", "using A.Core; namespace B; public class Use : Base { public void Run() { Go(1); } public void More(Base b) { b.Go(2); } }")
    write("one/notes.txt", "not a source")
    git("add", ".")
    git("commit", "-qm", "2")
    write("one/Base.cs", core.replace("Base", "Lost"))  # not committed
    assert run("--changed-only") == 0 and "Indexed 1 projects" in out.getvalue()
    after = graph_dir.read_graph(spark, g)
    edges = set(pairs(after.edges))
    assert {("B.Use", "A.Core.Base", "inherits"), ("B.Use.Run()", "A.Core.Base.Go(int)", "calls"), ("B.Use.More(A.Core.Base)", "A.Core.Base.Go(int)", "calls")} <= edges
    assert after.nodes.where("id = 'A.Core.Base'").count() == 1 and after.nodes.where("id like '%Lost%'").count() == 0 and after.nodes.where("id = 'A.Core.Base' and file_path <> ''").count() == 1


def test_impact(spark):
    g = orders(spark)
    rows = extract.impact(g, spark.createDataFrame([("src/OrderService.cs",), ("x/None.cs",)], "path string")).collect()
    assert sorted((r["symbol"], r["id"], r["depth"]) for r in rows) == [("OrderService", "MyApp.Services.OrderService", 0), ("OrderService", "MyApp.Services.OrderService.PlaceOrder", 1)]
    assert query(g, QueryOptions("type:OrderService", 0)).match_count == 1


def test_stream(spark, tmp_path):
    def batch(n, project, names, version):
        g = graph(spark, [node(x) for x in names], [])
        from pyspark.sql import functions as F

        rows = g.nodes.drop("ord").agg(F.collect_list(F.struct(*[c.split(" ")[0] for c in NODES.split(", ")])).alias("nodes"))
        empty = g.edges.drop("ord").agg(F.collect_list(F.struct(*[c.split(" ")[0] for c in EDGES.split(", ")])).alias("edges"))
        rows.crossJoin(empty).select(F.lit(project).alias("project"), F.lit(version).alias("version"), "nodes", "edges").write.mode("append").parquet(str(tmp_path / "in"))

    def advance():
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    batch(0, "A", ["A.x", "A.y"], 1)
    advance()
    batch(1, "A", ["A.z"], 2)
    batch(1, "B", ["B.x"], 1)
    advance()
    assert ids(spark.read.parquet(str(tmp_path / "out" / "v=1" / "nodes"))) == ["A.z", "B.x"]
