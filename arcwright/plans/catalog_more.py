"""More queries with SQL: scalar functions, orders, samples that fit or don't, groups of edges, and edges from declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.operators import binding
from arcwright.operators import extract as E
from arcwright.operators import sets as S
from arcwright.operators import traverse as T
from arcwright.operators import views as V
from arcwright.plans.catalog import QUERIES, SEED, SQL, _federated, register  # noqa: F401
from arcwright.plans.tables import frames, star_graph

# Scalar functions


@register("select id, regexp_extract(id, '([^.]*)$', 1) as last, regexp_replace(id || ':' || kind || '?', '[<>:\"/\\\\|?*]', '_', 'g') as file from nodes")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_graph(spark, sf_dir).nodes
    return nodes.select("id", X.last_segment("id").alias("last"), X.file_name(F.concat("id", F.lit(":"), "kind", F.lit("?"))).alias("file"))


_PATH = "'src\\' || (o_custkey % 7) || '/m' || (o_custkey % 3) || '/o.' || o_orderkey || case o_orderkey % 3 when 0 then '.CS' when 1 then '.json' else '' end"


@register(
    f"""+paths as (select o_orderkey, {_PATH} as path from orders), flat as (select *, replace(path, '\\', '/') as flat from paths)
select o_orderkey, flat, regexp_extract(flat, '^(.*)/[^/]*$', 1) as folder, regexp_replace(regexp_extract(flat, '([^/]*)$', 1), '\\.[^.]*$', '') as stem,
lower(regexp_extract(flat, '(\\.[^./]*)$', 1)) as extension, substring(flat, 5) as relative from flat"""
)
def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frames(spark, sf_dir)["orders"]
    end = F.when(F.col("o_orderkey") % 3 == 0, ".CS").when(F.col("o_orderkey") % 3 == 1, ".json").otherwise("")
    paths = o.select("o_orderkey", F.concat(F.lit("src\\"), F.col("o_custkey") % 7, F.lit("/m"), F.col("o_custkey") % 3, F.lit("/o."), "o_orderkey", end).alias("path"), F.lit("SRC/").alias("root"))
    return paths.select("o_orderkey", X.slashes("path").alias("flat"), X.folder(X.slashes("path")).alias("folder"), X.stem("path").alias("stem"), X.extension("path").alias("extension"), X.relative("path", "root").alias("relative"))


@register("select o_orderkey, case when o_orderkey % 5 = 0 then 'unknown' else substring(md5(cast(o_orderkey as varchar)), 1, 7) end as short, substring(cast(cast(o_orderdate as date) as varchar), 1, 10) as day, substring(sha256(cast(o_orderkey as varchar)), 1, 8) as prefix from orders")
def text_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    o = frames(spark, sf_dir)["orders"].withColumn("hash", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.md5(key)))
    return o.select("o_orderkey", X.short_commit("hash").alias("short"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.substring(F.sha2(key, 256), 1, 8).alias("prefix"))


@register("select p_partkey, regexp_replace(lower(p_brand || ' ' || p_type || '/É'), '[^a-z0-9_.-]', '-', 'g') as slug from part")
def text_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir)["part"].select("p_partkey", X.slug(F.concat("p_brand", F.lit(" "), "p_type", F.lit("/É"))).alias("slug"))


@register(
    """+asked as (select o_orderkey, ' ' || o_orderpriority || ',, ' || o_orderstatus || ' ,' as list, case when o_orderkey % 3 = 0 then '12.5' when o_orderkey % 3 = 1 then 'x1' end as n from orders)
select o_orderkey, array_to_string([trim(x) for x in string_split(list, ',') if trim(x) <> ''], '|') as parts, coalesce(try_cast(n as double), 0.0) as number from asked"""
)
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frames(spark, sf_dir)["orders"].withColumn("list", F.concat(F.lit(" "), "o_orderpriority", F.lit(",, "), "o_orderstatus", F.lit(" ,")))
    o = o.withColumn("n", F.when(F.col("o_orderkey") % 3 == 0, "12.5").when(F.col("o_orderkey") % 3 == 1, "x1"))
    return o.select("o_orderkey", F.array_join(X.parts("list"), "|").alias("parts"), X.number_or_zero("n").alias("number"))


@register("select p_partkey, case when p_size % 4 = 3 then 'Nullable' else 'T' || p_partkey end as bare from part")
def text_bare_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.concat(F.lit("T"), "p_partkey"), F.col("p_size") % 4
    text = F.when(k == 0, F.concat(F.lit("System.Nullable<"), t, F.lit(">"))).when(k == 1, F.concat(t, F.lit("?[,][]"))).when(k == 3, "Nullable?").otherwise(t)
    return frames(spark, sf_dir)["part"].withColumn("t", text).select("p_partkey", X.bare_type("t").alias("bare"))


_MODIFIERS = ("public static", "protected internal", "internal protected", "private protected", "internal", "protected virtual", "static", None, "PUBLIC")
_NAMES = ("public", "protectedInternal", "protectedInternal", "privateProtected", "internal", "protected", "private", "private", "public")


@register("select p_partkey, case p_partkey % 9 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end as access from part")
def text_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.element_at(F.array(*(F.lit(m).cast("string") for m in _MODIFIERS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return frames(spark, sf_dir)["part"].withColumn("m", written).select("p_partkey", X.accessibility("m").alias("access"))


@register("select p_partkey, case when p_size % 3 = 0 then null else p_name || ' of ' || p_brand || ' & <more>' end as doc from part")
def text_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.lit("<summary>\n  "), "p_name", F.lit(" <b>of</b>\n "), "p_brand", F.lit(" &amp; &lt;more&gt; </summary><remarks>no</remarks>"))
    return frames(spark, sf_dir)["part"].withColumn("x", F.when(F.col("p_size") % 3 == 0, "<summary> </summary>").otherwise(full)).select("p_partkey", X.doc_summary("x").alias("doc"))


# Orders, samples, groups


def _lined(df: DataFrame, *order) -> DataFrame:
    """Rows with their place in an order, for a table that fits a report."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@register("select * from (select id, row_number() over (order by degree desc, id) as place from (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by id)) where place <= 100")
def degree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(V.degrees(star_graph(spark, sf_dir).edges).orderBy(F.desc("degree"), "id").limit(100), F.desc("degree"), "id").select("id", "place")


@register("select id from nodes order by ord, id limit 10")
def sample_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and namespaces don't fit: the first nodes in load order."""
    return V.sample(star_graph(spark, sf_dir), 10).nodes.select("id")


@register("select from_id, to_id, type from edges")
def sample_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that fits stays whole, with edges that lead nowhere."""
    return V.sample(star_graph(spark, sf_dir), 10**9).edges.select("from_id", "to_id", "type")


@register(f"select case when from_id = '{SEED}' then 'out' else 'in' end as way, type, count(*) as n, count(distinct case when from_id = '{SEED}' then to_id else from_id end) as others from edges where '{SEED}' in (from_id, to_id) group by all")
def edge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges around a node, by direction and type."""
    edges = star_graph(spark, sf_dir).edges.where((F.col("from_id") == SEED) | (F.col("to_id") == SEED))
    out = F.col("from_id") == SEED
    rows = edges.select(F.when(out, "out").otherwise("in").alias("way"), "type", F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("other"))
    return rows.groupBy("way", "type").agg(F.count("*").alias("n"), F.countDistinct("other").alias("others"))


@register("+solutions as (select lower(r_name) as solution from region) select solution, (select count(*) from nodes where lower(assembly_name) = solution) + (select count(*) from nodes where assembly_name in ('', 'EVENTS')) as n from solutions")
def fed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each solution before they are brought together."""
    return _federated(spark, sf_dir)[0].groupBy("solution").agg(F.count("*").alias("n"))


# Edges from declarations: customers and suppliers as types of their nations' namespaces, orders as their methods

_DECLS = """c as (select r_name || '.' || n_name as ns, c_custkey as k, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
s as (select r_name || '.' || n_name as ns, s_suppkey as k, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
t as (select ns || '.C' || k as id, r_name as assembly, ns, k from c)"""
_SUPPLIER = "(select ns || '.S' || k as id, r_name as assembly, k from s)"


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(types and methods, the types alone). A customer's base is a supplier by its full name, one in eleven is outside; its interface one of its nation."""
    g = frames(spark, sf_dir)
    place = g["nation"].join(g["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("."), "n_name").alias("ns"), "r_name")
    s = g["supplier"].join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("ns", F.lit(".S"), "s_suppkey").alias("symbol_id"), F.col("r_name").alias("assembly"), "s_suppkey")
    suppliers = s.agg(F.count("*").alias("many"))
    c = g["customer"].join(place, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(suppliers))  # one row
    c = c.withColumn("__s", (F.col("c_custkey") % F.col("many") + 1)).join(s.select(F.col("s_suppkey").alias("__s"), F.col("symbol_id").alias("__base")), "__s")
    base = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("Outside.B"), F.col("c_custkey") % 3)).otherwise(F.col("__base"))
    none = F.array().cast("array<string>")
    types = c.select(F.lit("type").alias("kind"), F.lit("class").alias("type_kind"), F.concat("ns", F.lit(".C"), "c_custkey").alias("symbol_id"), F.concat(F.lit("C"), "c_custkey").alias("name"), F.lit(None).cast("string").alias("containing_type"), F.col("r_name").alias("assembly"),
                     F.array(base, F.lit("object")).alias("bases"), F.array(F.concat("ns", F.lit(".I"))).alias("ifaces"), F.lit(None).cast("string").alias("return_type"), none.alias("param_types"), F.lit(None).cast("string").alias("overridden"))
    more = s.select(F.lit("type").alias("kind"), F.lit("class").alias("type_kind"), "symbol_id", F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit(None).cast("string").alias("containing_type"), "assembly", none.alias("bases"), none.alias("ifaces"), F.lit(None).cast("string").alias("return_type"), none.alias("param_types"), F.lit(None).cast("string").alias("overridden"))
    types = types.unionByName(more)
    methods = types.select(F.lit("method").alias("kind"), F.lit(None).cast("string").alias("type_kind"), F.concat("symbol_id", F.lit(".Run(int)")).alias("symbol_id"), F.lit("Run").alias("name"), F.col("symbol_id").alias("containing_type"), "assembly", none.alias("bases"), none.alias("ifaces"),
                           F.concat(F.coalesce(F.get("bases", F.lit(0)), F.lit("void")), F.lit("?")).alias("return_type"), F.array(F.lit("int")).alias("param_types"), F.when(F.size("bases") > 0, "Run(int)").alias("overridden"))
    return types.unionByName(methods), types


_BASED = _DECLS + ", n as (select count(*) as many from supplier), based as (select t.id, t.assembly, t.ns, case when t.k % 11 = 0 then 'Outside.B' || (t.k % 3) else b.id end as base, case when t.k % 11 = 0 then null else b.assembly end as base_assembly from t, n, " + _SUPPLIER + " b where b.k = t.k % n.many + 1)"


@register(f"+{_BASED} select id as from_id, base as to_id, 'inherits' as type, coalesce(assembly <> base_assembly, true) as is_external from based")
def inherits_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls, types = _declared(spark, sf_dir)
    return E.inherits_edges(decls, types).select("from_id", "to_id", "type", "is_external")


@register(f"+{_BASED} select id as from_id, ns || '.I' as to_id, 'implements' as type, true as is_external from based")
def implements_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls, types = _declared(spark, sf_dir)
    return E.implements_edges(decls, types).select("from_id", "to_id", "type", "is_external")


@register(f"+{_BASED} select id || '.Run(int)' as from_id, base as to_id, 'dependsOn' as type, coalesce(assembly <> base_assembly, true) as is_external from based")
def depends_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls, types = _declared(spark, sf_dir)
    return E.depends_edges(decls, types).select("from_id", "to_id", "type", "is_external")


@register(f"+{_BASED} select id || '.Run(int)' as from_id, base || '.Run(int)' as to_id, 'overrides' as type, coalesce(assembly <> base_assembly, true) as is_external from based")
def overrides_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls = binding.overridden(_declared(spark, sf_dir)[0])
    return E.overrides_edges(decls, decls).select("from_id", "to_id", "type", "is_external")


@register(f"+{_BASED} select distinct base as id, regexp_extract(base, '([^.]*)$', 1) as name, 'type' as kind, 'Unknown' as outside from based where base_assembly is null union select distinct ns || '.I', 'I', 'type', 'Unknown' from based")
def external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls, types = _declared(spark, sf_dir)
    edges = E.inherits_edges(decls, types).unionByName(E.implements_edges(decls, types))
    refs = spark.createDataFrame([], "target_id string, target_kind string, target_assembly string")
    found = E.external_nodes(edges, types.select(F.col("symbol_id").alias("id")), refs)
    return found.select("id", "name", "kind", F.col("metadata")["assembly"].alias("outside"))


@register("""+up as (select 'C' || c_custkey as key, 'S' || (c_custkey % 10 + 1) as base from customer union select 'S' || s_suppkey, 'N' || s_nationkey from supplier union select 'N' || n_nationkey, 'R' || n_regionkey from nation),
walk(key, above, depth) as (select key, key, 0 from up union select walk.key, base, depth + 1 from walk join up on walk.above = up.key) select key, above, cast(min(depth) as int) as depth from walk group by key, above""")
def base_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types above each type, through any number of base types."""
    g = frames(spark, sf_dir)
    pairs = g["customer"].select(F.concat(F.lit("C"), "c_custkey").alias("symbol_id"), F.concat(F.lit("S"), F.col("c_custkey") % 10 + 1).alias("base"))
    pairs = pairs.unionByName(g["supplier"].select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey")).toDF("symbol_id", "base"))
    pairs = pairs.unionByName(g["nation"].select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey")).toDF("symbol_id", "base"))
    return binding.ancestors(pairs.select(F.lit("type").alias("kind"), "symbol_id", F.array("base").alias("bases"), F.array().cast("array<string>").alias("ifaces")))


@register("select id, row_number() over (order by id) as place from nodes where kind = 'namespace' or (kind = 'type' and id like '%Supplier%')")
def diff_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added nodes in the order in which a comparison lists them."""
    g = star_graph(spark, sf_dir)
    part = g.nodes.where((F.col("kind") == "namespace") | ((F.col("kind") == "type") & F.col("id").contains("Supplier")))
    from dataclasses import replace

    found = S.diff(replace(g, nodes=part.limit(0), edges=g.edges.limit(0)), replace(g, nodes=part, edges=g.edges.limit(0)))
    return _lined(found.added_nodes.select("id"), "id")


@register(f"select distinct case when from_id = '{SEED}' then to_id else from_id end as id from edges where '{SEED}' in (from_id, to_id) and from_id <> to_id")
def neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of one node, also across external edges."""
    ways = T.adjacency(star_graph(spark, sf_dir).edges, True)
    return ways.where((F.col("src") == SEED) & (F.col("dst") != SEED)).select(F.col("dst").alias("id")).distinct()
