"""Names to declared symbols: by containing types, namespaces and usings, then through base types, as joins.

Every step is an equi-join on a full name; nothing is looked up on the driver, and a hot name (a base
class of everything) has one row on its declaring side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.operators.durable import keep

#: Base types that are followed upwards at most, in case types derive from each other.
DEEPEST = 64


def bare(name: str | Column) -> Column:
    """A full name without type arguments."""
    return F.regexp_replace(name, "<.*>", "")


def _arity(id_: str) -> Column:
    last = F.regexp_extract(id_, r"<([^<>]*)>$", 1)
    return F.when(last == "", F.lit(0)).otherwise(F.size(F.split(last, ",")))


def resolve(names: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(assembly, file, known) from rows (what, assembly, file, scope, name, arity, candidates, id, type_kind): what each name in a file stands for.

    The first candidate that is declared counts, then what the project uses everywhere; of types of one name the one of the own assembly, then the lowest assembly.
    known is an array of (scope, name, arity, full, type_kind), as long as its file has names.
    """
    declared = names.where("what = 'type'").select("assembly", "id", "type_kind")
    if types is not None:
        declared = declared.unionByName(types.select("assembly", "id", "type_kind"))
    declared = declared.select(F.concat(bare("id"), F.lit("`"), _arity("id").cast("string")).alias("key"), bare("id").alias("full"), "type_kind", F.col("assembly").alias("of"))
    declared = declared.groupBy("key", "of").agg(F.min("full").alias("full"), F.min("type_kind").alias("type_kind"))
    shared = names.where("what = 'using'").groupBy("assembly").agg(F.sort_array(F.collect_set("name")).alias("everywhere"))
    wanted = names.where("what = 'name'").join(shared, "assembly", "left")
    more = F.transform(F.coalesce("everywhere", F.array().cast("array<string>")), lambda u: F.concat(u, F.lit("."), F.col("name"), F.lit("`"), F.col("arity").cast("string")))
    wanted = wanted.select("assembly", "file", "scope", "name", "arity", F.posexplode(F.concat("candidates", more)).alias("place", "key"))
    hits = wanted.join(declared, "key").groupBy("assembly", "file", "scope", "name", "arity")
    best = hits.agg(F.min(F.struct("place", (F.col("of") != F.col("assembly")).alias("else"), "of", "full", "type_kind")).alias("b"))
    return best.groupBy("assembly", "file").agg(F.collect_list(F.struct("scope", "name", "arity", F.col("b.full").alias("full"), F.col("b.type_kind").alias("type_kind"))).alias("known"))


def ancestors(decls: DataFrame) -> DataFrame:
    """(key, above, depth) of each type: itself, its base types and interfaces, and theirs, by names without type arguments."""
    types = decls.where("kind = 'type'")
    up = types.select(bare("symbol_id").alias("key"), F.explode(F.concat("bases", "ifaces")).alias("base")).select("key", bare("base").alias("base")).where("key <> base").distinct()
    up = keep(up)
    found = types.select(bare("symbol_id").alias("key")).distinct().select("key", F.col("key").alias("above"), F.lit(0).alias("depth"))
    last = found
    for depth in range(1, DEEPEST + 1):
        last = keep(last.join(up.withColumnRenamed("key", "above"), "above").select("key", F.col("base").alias("above"), F.lit(depth).alias("depth")).distinct())
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return keep(found.groupBy("key", "above").agg(F.min("depth").alias("depth")))


def targets(decls: DataFrame, refs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """References with target_id, target_kind and target_assembly; others are declarations elsewhere.

    A reference whose receiver's type is known means the member of that name and of a fitting number
    of parameters in that type, or else in the nearest type above it (of equals the one of fewest
    parameters, then the lowest id). A creation means a constructor of the type, or the implicit one
    without parameters. Where the receiver isn't known or has no such member, a name that is declared
    once in all sources is taken.
    """
    wide = decls if others is None else decls.unionByName(others, allowMissingColumns=True)
    count = F.size(F.coalesce("param_types", F.array().cast("array<string>")))
    fits = F.when(F.col("kind") == "constructor", "creation").when(F.col("kind") == "method", "invocation").when(F.col("kind").isin("property", "field", "event"), "memberAccess")
    members = wide.withColumn("ref", fits).where("ref is not null").select(bare("containing_type").alias("above"), "ref", "name", count.alias("most"), F.coalesce("required", count).alias("least"), F.col("symbol_id").alias("target_id"), F.col("kind").alias("target_kind"), F.col("assembly").alias("target_assembly"))
    above = ancestors(wide)
    rows = refs.withColumn("__id", F.xxhash64("assembly", "file", "pos", "kind", "name"))
    called = rows.where("size(receivers) > 0").select("__id", F.col("kind").alias("ref"), "name", "args", F.posexplode("receivers").alias("place", "key")).join(above, "key").where("ref <> 'creation' or depth = 0")
    same = (called["above"] == members["above"]) & (called["ref"] == members["ref"]) & (F.when(called["ref"] == "creation", True).otherwise(called["name"] == members["name"]))
    hits = called.join(members, same).where((called["ref"] == "memberAccess") | F.col("args").between(F.col("least"), F.col("most")))
    best = hits.groupBy("__id").agg(F.min(F.struct("place", "depth", (F.col("most") - F.col("args")).alias("more"), "target_id", "target_kind", "target_assembly")).alias("b"))
    best = best.select("__id", F.col("b.target_id").alias("target_id"), F.col("b.target_kind").alias("target_kind"), F.col("b.target_assembly").alias("target_assembly"))
    plain = wide.where("kind = 'type' and coalesce(type_kind, 'class') not in ('interface', 'enum')").select(bare("symbol_id").alias("key"), F.col("symbol_id").alias("type_id"), "name", F.col("assembly").alias("target_assembly")).dropDuplicates(["key"])
    made = rows.where("kind = 'creation' and args = 0").select("__id", F.element_at("receivers", 1).alias("key")).join(best.select("__id"), "__id", "left_anti").join(plain, "key")
    made = made.select("__id", F.concat("type_id", F.lit("."), "name", F.lit("()")).alias("target_id"), F.lit("constructor").alias("target_kind"), "target_assembly")
    bound = best.unionByName(made)
    once = members.where("ref <> 'creation'").groupBy("name", "ref").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("target_id", "target_kind", "target_assembly"))).where("n = 1").drop("n")
    rest = rows.join(bound.select("__id"), "__id", "left_anti").select("__id", "name", F.col("kind").alias("ref")).join(once, ["name", "ref"]).drop("name", "ref")
    return rows.join(bound.unionByName(rest), "__id").drop("__id")


def overridden(decls: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """decls whose overridden, a method's name and parameters, is the id of what it overrides: in the nearest type above that declares it; else below the name of the base type, or null without one."""
    wide = decls if others is None else decls.unionByName(others, allowMissingColumns=True)
    above = ancestors(wide).where("depth > 0")
    mine = decls.where("overridden is not null").select("symbol_id", "name", F.size("param_types").alias("n"), "overridden", bare("containing_type").alias("key"), "containing_type").distinct()
    methods = wide.where("kind = 'method'").select(bare("containing_type").alias("above"), "name", F.size(F.coalesce("param_types", F.array().cast("array<string>"))).alias("n"), F.col("symbol_id").alias("base_id"))
    same = F.col("base_id").endswith(F.concat(F.lit("."), F.col("overridden")))
    hits = mine.join(above, "key").join(methods, ["above", "name", "n"]).groupBy("symbol_id").agg(F.min(F.struct("depth", (~same).alias("else"), "base_id")).alias("b"))
    first = wide.where("kind = 'type' and size(bases) > 0").select(F.col("symbol_id").alias("containing_type"), F.get("bases", F.lit(0)).alias("base")).dropDuplicates(["containing_type"])
    told = mine.join(hits, "symbol_id", "left").join(first, "containing_type", "left").select("symbol_id", F.coalesce(F.col("b.base_id"), F.concat("base", F.lit("."), "overridden")).alias("__id")).dropDuplicates(["symbol_id"])
    return decls.join(told, "symbol_id", "left").withColumn("overridden", F.col("__id")).drop("__id").select(decls.columns)


def stored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declarations as :func:`targets` takes them, from nodes and edges of a stored graph."""
    own = nodes.where("file_path <> ''")
    inside = F.regexp_extract("id", r"\(([^()]*)\)$", 1)
    flat = F.regexp_replace(F.regexp_replace(inside, "<[^<>]*>", ""), "<[^<>]*>", "")
    params = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(flat, ", ?"))
    ups = edges.where("type in ('inherits', 'implements')").groupBy(F.col("from_id").alias("id")).agg(F.collect_set(F.when(F.col("type") == "inherits", F.col("to_id"))).alias("bases"), F.collect_set(F.when(F.col("type") == "implements", F.col("to_id"))).alias("ifaces"))
    empty = F.array().cast("array<string>")
    kind = F.when((F.col("kind") == "method") & (F.col("name") == F.element_at(F.split(bare("containing_type_id"), r"\."), -1)), "constructor").otherwise(F.col("kind"))
    type_kind = F.when(F.col("kind") == "type", F.regexp_extract("signature", r"\b(class|interface|struct|enum|record)\b", 1))
    return own.join(ups, "id", "left").select(
        F.col("assembly_name").alias("assembly"), kind.alias("kind"), type_kind.alias("type_kind"), F.col("id").alias("symbol_id"), "name", F.col("containing_type_id").alias("containing_type"),
        params.alias("param_types"), F.coalesce("bases", empty).alias("bases"), F.coalesce("ifaces", empty).alias("ifaces"),
    )
