"""From facts about source text to nodes and edges.

Facts are two tables. decls has a row for each declared symbol (assembly, file, start, end, kind,
symbol_id, name, containing_type, containing_ns, modifiers, signature, return_type, param_types, bases,
ifaces, overridden, attributes, doc_xml); refs one for each reference (assembly, file, pos, kind,
target_id, target_kind, target_assembly).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.model import Graph
from arcwright.operators import binding
from arcwright.operators.binding import bare
from arcwright.operators.durable import keep, small

MEMBERS = ("method", "constructor", "property", "field", "event")
CALLERS = ("method", "constructor", "property", "event")
REGISTRATIONS = tuple(f"{add}{life}" for add in ("Add", "TryAdd") for life in ("Singleton", "Scoped", "Transient"))
FRAMEWORKS = {"xUnit": ("Fact", "Theory"), "NUnit": ("Test", "TestCase", "TestCaseSource"), "MSTest": ("TestMethod", "DataTestMethod")}
_SPECIAL = ("void", "bool", "byte", "sbyte", "char", "decimal", "double", "float", "int", "uint", "nint", "nuint", "long", "ulong", "object", "short", "ushort", "string", "dynamic")


def _edge(from_: Column, to: Column, type_: Column | str, external: Column, metadata: Column | None = None, resolution: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        from_.alias("from_id"), to.alias("to_id"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"), external.alias("is_external"), none.alias("package_source"), none.alias("source_link"),
        (none if resolution is None else resolution).alias("resolution"), (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
    ]


def outside(assembly: str, target: str) -> Column:
    """The target's assembly isn't the one that is compiled; unknown counts as outside."""
    return ~F.coalesce(F.col(assembly) == F.col(target), F.lit(False))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["from_id", "to_id", "type"])


def declaration_nodes(decls: DataFrame, root: str = "") -> DataFrame:
    """A node for each declaration; of a namespace that is declared often, one."""
    flags = ("abstract", "static", "sealed", "virtual", "override", "async", "const", "readonly")
    has = lambda w: F.concat(F.lit(" "), F.coalesce("modifiers", F.lit("")), F.lit(" ")).contains(f" {w} ")
    names = {"readonly": "isReadOnly"}
    entries = [F.when(has(w), F.struct(F.lit(names.get(w, "is" + w.capitalize())).alias("key"), F.lit("true").alias("value"))) for w in flags]
    types = F.when(F.col("kind").isin("method", "property", "field") & F.col("return_type").isNotNull(), F.struct(F.concat("kind", F.lit("Type")).alias("key"), F.col("return_type").alias("value")))
    metadata = F.map_from_entries(F.filter(F.array(*entries, types), lambda x: x.isNotNull()))
    space = F.col("kind") == "namespace"
    nodes = decls.withColumn("__root", F.lit(root)).select(
        F.col("symbol_id").alias("id"), "name", "kind", X.relative("file", "__root").alias("file_path"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
        F.coalesce("signature", F.lit("")).alias("signature"), F.when(~space, X.doc_summary("doc_xml")).alias("doc_comment"), F.col("containing_type").alias("containing_type_id"), F.col("containing_ns").alias("containing_namespace_id"),
        F.when(space, "public").otherwise(X.accessibility("modifiers")).alias("accessibility"), F.col("assembly").alias("assembly_name"), metadata.alias("metadata"), F.col("file").alias("__f"), F.col("start").alias("__s"),
    )
    from arcwright.operators.sets import pick

    first = pick(nodes.where("kind = 'namespace'"), ["assembly_name", "id"], ["__f", "__s"])
    return nodes.where("kind <> 'namespace'").unionByName(first).drop("__f", "__s")


def contains_edges(decls: DataFrame) -> DataFrame:
    """From the containing type, or else the namespace, to each declaration but namespaces; none from nowhere."""
    parent = F.when(F.col("kind") == "type", F.coalesce("containing_type", F.col("containing_ns"))).otherwise(F.col("containing_type"))
    return decls.where("kind <> 'namespace'").withColumn("__p", parent).where("__p <> ''").select(_edge(F.col("__p"), F.col("symbol_id"), "contains", F.lit(False)))


def _targets(decls: DataFrame, targets: Column, type_: str, assemblies: DataFrame | None) -> DataFrame:
    free = F.coalesce("type_params", F.array().cast("array<string>")) if "type_params" in decls.columns else F.array().cast("array<string>")
    rows = decls.select("symbol_id", "assembly", F.explode(F.array_except(targets, free)).alias("target")).where("target <> symbol_id and target <> ''")
    if assemblies is None:
        rows = rows.withColumn("target_assembly", F.col("assembly"))
    else:
        known = assemblies.select(bare("symbol_id").alias("__key"), F.col("assembly").alias("target_assembly")).groupBy("__key").agg(F.min("target_assembly").alias("target_assembly"), F.collect_set("target_assembly").alias("__all"))
        rows = rows.withColumn("__key", bare("target")).join(known, "__key", "left")
        rows = rows.withColumn("target_assembly", F.when(F.array_contains("__all", F.col("assembly")), F.col("assembly")).otherwise(F.col("target_assembly")))
    return distinct_edges(rows.select(_edge(F.col("symbol_id"), F.col("target"), type_, outside("assembly", "target_assembly"))))


def inherits_edges(decls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """From types to their base types; interfaces have none, object and value types don't count."""
    bases = F.filter("bases", lambda b: ~b.isin("object", "System.Object", "System.ValueType", "System.Enum"))
    return _targets(decls.where("kind = 'type' and coalesce(type_kind, '') <> 'interface'"), bases, "inherits", known)


def implements_edges(decls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """From classes, structs and records to the interfaces that they declare."""
    return _targets(decls.where("kind = 'type' and coalesce(type_kind, '') <> 'interface'"), F.col("ifaces"), "implements", known)


def depends_edges(decls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """From members to the types of their value and parameters, without marks of nullable values and arrays; built-in types don't count."""
    value = F.when(F.col("kind") == "constructor", F.array().cast("array<string>")).otherwise(F.array("return_type"))
    types = F.transform(F.concat(value, F.coalesce("param_types", F.array().cast("array<string>"))), X.bare_type)
    plain = F.array_distinct(F.filter(types, lambda t: t.isNotNull() & ~t.isin(*_SPECIAL)))
    return _targets(decls.where(F.col("kind").isin("method", "constructor", "property", "field")), plain, "dependsOn", known)


def overrides_edges(decls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """From overriding methods to what they override."""
    return _targets(decls.where("kind = 'method' and overridden is not null"), F.array("overridden"), "overrides", known)


def owned(decls: DataFrame, refs: DataFrame, width: int = 1024, kinds: tuple[str, ...] = CALLERS) -> DataFrame:
    """References with their owner, the innermost member whose text holds them; those outside any are dropped.

    Positions are cut into stretches of ``width``, and members listed in each they touch, so that the
    join compares a reference only with members near it, not with all of its file.
    """
    spans = decls.where(F.col("kind").isin(*kinds)).select("assembly", "file", "start", "end", F.col("symbol_id").alias("owner"))
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    near = refs.withColumn("__b", F.floor(F.col("pos") / width)).join(spans, ["assembly", "file", "__b"]).where("pos between start and end")
    return near.groupBy(refs.columns).agg(F.max_by("owner", F.struct("start", "owner")).alias("owner"))


def reference_edges(decls: DataFrame, refs: DataFrame, width: int = 1024) -> DataFrame:
    """Calls for invocations and object creations, references for other accesses to members that aren't methods, not to oneself."""
    rows = owned(decls, refs.select("assembly", "file", "pos", "kind", "target_id", "target_kind", "target_assembly"), width)
    call = F.col("kind").isin("invocation", "creation")
    access = (F.col("kind") == "memberAccess") & F.col("target_kind").isin("property", "field", "event") & (F.col("target_id") != F.col("owner"))
    rows = rows.where(call | access).withColumn("type", F.when(call, "calls").otherwise("references"))
    once = rows.groupBy("owner", "target_id", "type").agg(F.bool_or(outside("assembly", "target_assembly")).alias("external"))
    return once.select(_edge(F.col("owner"), F.col("target_id"), F.col("type"), F.col("external")))


def external_nodes(edges: DataFrame, nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """A node for each target outside that no node has: without a file, with its assembly among the metadata; constructors as methods.

    What no reference tells of, as base types and parameters' types, is a type (below ``overrides`` a
    method), of the assembly "Unknown". Constructed types of declared ones have no node.
    """
    known = refs.groupBy(F.col("target_id").alias("id")).agg(F.first("target_kind", True).alias("kind"), F.first("target_assembly", True).alias("outside"))
    wanted = edges.where("type not in ('covers', 'coveredBy', 'contains')").select(F.col("to_id").alias("id"), "type", "is_external")
    wanted = wanted.unionByName(edges.where("type = 'resolvesTo'").select(F.col("from_id").alias("id"), "type", F.lit(True).alias("is_external")))
    wanted = wanted.groupBy("id").agg(F.bool_or((F.col("type") == "overrides") | (F.col("type") == "calls")).alias("method"), F.bool_or(F.col("is_external") | (F.col("type") == "resolvesTo")).alias("out"))
    told = wanted.join(nodes.select("id"), "id", "left_anti").join(known, "id", "left").where("kind is not null or out")
    told = told.join(nodes.select(bare("id").alias("__key")).distinct(), bare("id") == F.col("__key"), "left").where("kind is not null or __key is null").drop("__key")
    kind = F.coalesce(F.when(F.col("kind") == "constructor", "method").otherwise(F.col("kind")), F.when(F.col("method"), "method").otherwise("type"))
    outside_ = F.coalesce("outside", F.when(F.col("kind").isNull(), "Unknown"))
    metadata = F.when(outside_.isNotNull(), F.create_map(F.lit("assembly"), outside_)).otherwise(F.create_map().cast("map<string,string>"))
    none = F.lit(None).cast("string")
    return told.select(
        "id", X.last_segment(F.regexp_replace(F.regexp_replace("id", r"\(.*$", ""), "<.*$", "")).alias("name"), kind.alias("kind"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("").alias("signature"),
        none.alias("doc_comment"), none.alias("containing_type_id"), none.alias("containing_namespace_id"), F.lit("public").alias("accessibility"), F.coalesce("outside", F.lit("")).alias("assembly_name"), metadata.alias("metadata"),
    )


def di_edges(calls: DataFrame) -> DataFrame:
    """From services to what resolves them, of registrations (method, type_args, typeof_args, file): two type arguments, or else two typeof arguments. Repeated ones stay."""
    pair = F.when(F.size("type_args") == 2, F.col("type_args")).when((F.size("type_args") <= 0) & (F.size("typeof_args") >= 2), F.col("typeof_args"))
    rows = calls.where(F.col("method").isin(*REGISTRATIONS)).withColumn("__pair", pair).where("__pair is not null and __pair[0] is not null and __pair[1] is not null")
    service, target, life = F.col("__pair")[0], F.col("__pair")[1], X.lifetime("method")
    how = F.concat(X.last_segment(bare(service)), F.lit(" → "), X.last_segment(bare(target)), F.lit(" (registered: "), life, F.lit(")"))
    metadata = F.create_map(F.lit("lifetime"), life, F.lit("registrationFile"), F.coalesce("file", F.lit("")))
    return rows.select(_edge(service, target, "resolvesTo", F.lit(False), metadata, how))


def framework(attributes: str = "attributes") -> Column:
    """Test framework of the first attribute that marks a test, by its last dotted segment; null if none does."""
    names = F.transform(attributes, lambda a: F.regexp_replace(X.last_segment(a), "Attribute$", ""))
    one = lambda a: F.coalesce(*(F.when(a.isin(*marks), f) for f, marks in FRAMEWORKS.items()))
    return F.element_at(F.concat(F.filter(F.transform(names, one), lambda f: f.isNotNull()), F.array(F.lit(None).cast("string"))), 1)


def coverage_edges(tests: DataFrame, refs: DataFrame) -> DataFrame:
    """Covers from test methods to what they invoke in other assemblies, and coveredBy back, each once; both external.

    tests is (symbol_id, assembly, attributes), refs (owner, target_id, target_assembly).
    """
    marked = tests.withColumn("framework", framework()).where("framework is not null").select("symbol_id", "assembly", "framework")
    hits = refs.join(marked, refs["owner"] == marked["symbol_id"]).where(~F.equal_null("assembly", "target_assembly"))
    hits = hits.select("owner", "target_id", "framework").dropDuplicates(["owner", "target_id"])
    ways = F.array(F.struct(F.col("owner").alias("a"), F.col("target_id").alias("b"), F.lit("covers").alias("t")), F.struct(F.col("target_id").alias("a"), F.col("owner").alias("b"), F.lit("coveredBy").alias("t")))
    both = hits.select(F.explode(ways).alias("w"), "framework")
    return both.select(_edge(F.col("w.a"), F.col("w.b"), F.col("w.t"), F.lit(True), F.create_map(F.lit("testFramework"), "framework")))


def extract(decls: DataFrame, refs: DataFrame, calls: DataFrame | None = None, root: str = "", others: DataFrame | None = None) -> Graph:
    """The graph of facts: declarations, then references, registrations and tests, and nodes for what lies outside. others are declarations elsewhere, of which edges are external and nodes aren't made."""
    nodes = declaration_nodes(decls, root)
    decls = keep(binding.overridden(decls, others))
    wide = decls if others is None else decls.unionByName(others, allowMissingColumns=True)
    parts = [contains_edges(decls), *(f(decls, wide) for f in (inherits_edges, implements_edges, depends_edges, overrides_edges)), reference_edges(decls, refs)]
    if calls is not None:
        parts.append(di_edges(calls))
    invoked = owned(decls, refs.where(F.col("kind").isin("invocation")), kinds=("method",))
    parts.append(coverage_edges(decls.where("kind = 'method'").select("symbol_id", "assembly", "attributes"), invoked.select("owner", "target_id", "target_assembly")))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    there = nodes.select("id") if others is None else nodes.select("id").unionByName(others.select(F.col("symbol_id").alias("id")))
    return Graph(nodes.unionByName(external_nodes(edges, there, refs)), edges)


def impact(graph: Graph, files: DataFrame, depth: int = 1, types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(symbol, id, depth) of what lies within so many hops of the symbols named like the files, for all files at once.

    A symbol is a file's stem; seeds are the nodes whose id is it or ends with a dot and it. ``types``
    restricts the edges walked, ``most`` the rows of each symbol, the nearest and lowest ids first.
    """
    symbols = files.select(X.stem("path").alias("symbol")).where("symbol <> ''").distinct().withColumn("key", F.lower("symbol")).withColumn("n", F.size(F.split("key", r"\.")))
    symbols = keep(symbols)
    deepest = symbols.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    tails = graph.nodes.select("id", F.explode(F.array(*(F.lower(F.substring_index("id", ".", -n)) for n in range(1, deepest + 1)))).alias("key")).distinct()
    reached = keep(tails.join(small(symbols.select("symbol", "key")), "key").select("symbol", "id").distinct().withColumn("depth", F.lit(0)))
    edges = graph.edges.where("not is_external")
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    from arcwright.operators.traverse import adjacency

    ways, frontier = adjacency(edges), reached
    for hop in range(1, depth + 1):
        step = ways.join(small(frontier.select("symbol", F.col("id").alias("src"))), "src").select("symbol", F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(reached, ["symbol", "id"], "left_anti").withColumn("depth", F.lit(hop)))
        reached = reached.unionByName(frontier)
    if most is not None:
        from pyspark.sql import Window

        reached = reached.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "id"))).where(F.col("__n") <= most).drop("__n")
    return reached
