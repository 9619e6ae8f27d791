"""Solution and project files: texts in a DataFrame (path, content) to rows of what they declare."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions import text as X
from arcwright.operators import paths

_SLN = r'(?m)^\s*Project\("[^"]*"\)\s*=\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"'


def read_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder whose names match."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"))


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source texts below a folder, but for those in a folder called bin."""
    texts = read_texts(spark, folder, "*.cs")
    return texts.where(~F.exists(F.split("path", "/"), lambda s: F.lower(s) == "bin"))


def in_memory(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def solution_projects(solutions: DataFrame) -> DataFrame:
    """(solution, name, path, guid) of the C# projects of .sln files; paths with slashes."""
    groups = (F.regexp_extract_all("content", F.lit(_SLN), i) for i in (1, 2, 3))
    each = solutions.select(F.col("path").alias("solution"), F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("name", "file", "guid"))))).alias("p"))
    out = each.select("solution", F.col("p.name").alias("name"), X.slashes("p.file").alias("path"), F.col("p.guid").alias("guid"))
    return out.where(X.extension("path") == ".csproj")


def _elements(text: str) -> list[ET.Element]:
    try:
        return list(ET.fromstring(text).iter())
    except (ET.ParseError, TypeError, ValueError):
        return []


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def solution_x_projects(solutions: DataFrame) -> DataFrame:
    """The same of .slnx files: Project elements with a path to a C# project; malformed XML has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for solution, text in zip(frame.path, frame.content):
                for e in _elements(text):
                    path = (e.get("Path") or "").replace("\\", "/")
                    if _tag(e) == "Project" and path.lower().endswith(".csproj") and (e.get("Type") or "").lower() != "folder":
                        rows.append((solution, e.get("Name") or re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]), path, ""))
            yield pd.DataFrame(rows, columns=["solution", "name", "path", "guid"])

    return solutions.select("path", "content").mapInPandas(run, "solution string, name string, path string, guid string")


def all_solution_projects(solutions: DataFrame) -> DataFrame:
    """Projects of solution files of either format, by their extension."""
    x = X.extension("path") == ".slnx"
    return solution_projects(solutions.where(~x)).unionByName(solution_x_projects(solutions.where(x)))


def project_items(projects: DataFrame) -> DataFrame:
    """(path, item, key, value, ord) of XML project and properties files.

    item is property (key is its name), package (key, version), version (central package version),
    reference (to a project), framework or compile (source text of old projects). Malformed XML has none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame.path, frame.content):
                for n, e in enumerate(_elements(text)):
                    tag, include = _tag(e), e.get("Include") or e.get("Update")
                    if tag == "PropertyGroup":
                        rows += [(path, "property", _tag(c), c.text.strip(), n * 1000 + i) for i, c in enumerate(e) if c.text and c.text.strip()]
                    elif include and tag in ("PackageReference", "PackageVersion", "ProjectReference", "FrameworkReference", "Compile"):
                        child = next((c.text.strip() for c in e if _tag(c) == "Version" and c.text), None)
                        kind = {"PackageReference": "package", "PackageVersion": "version", "ProjectReference": "reference", "FrameworkReference": "framework", "Compile": "compile"}[tag]
                        value = e.get("Version") or e.get("VersionOverride") or child if kind in ("package", "version") else include.replace("\\", "/")
                        rows.append((path, kind, include, value, n * 1000))
            yield pd.DataFrame(rows, columns=["path", "item", "key", "value", "ord"])

    return projects.select("path", "content").mapInPandas(run, "path string, item string, key string, value string, ord bigint")


def best_framework(frameworks: str) -> Column:
    """Of a list of target frameworks the one whose digits and dots make the largest number."""
    rated = F.transform(X.parts(frameworks, ";"), lambda t: F.struct(X.number_or_zero(F.regexp_replace(t, "[^0-9.]", "")).alias("v"), t.alias("t")))
    return F.array_max(rated)["t"]


def project_table(projects: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """A row for each project: assembly, root_namespace, framework, nullable, lang_version.

    Own properties come before those of the nearest properties file above; the file's stem is the
    default of names.
    """
    own = project_items(projects).where("item = 'property'").groupBy("path", F.lower("key").alias("key")).agg(F.min_by("value", "ord").alias("value"))
    if props is not None:
        theirs = paths.inherited(projects, project_items(props).where("item = 'property'").select("path", "key", "value", "ord"))
        own = own.unionByName(theirs.join(own, ["path", "key"], "left_anti"))
    names = ("assemblyname", "rootnamespace", "targetframework", "targetframeworks", "nullable", "langversion")
    wide = own.groupBy("path").pivot("key", list(names)).agg(F.first("value"))
    found = projects.select("path").join(wide, "path", "left")
    return found.select(
        "path", F.coalesce("assemblyname", X.stem("path")).alias("assembly"), F.coalesce("rootnamespace", X.stem("path")).alias("root_namespace"),
        F.coalesce("targetframework", best_framework("targetframeworks")).alias("framework"), F.coalesce(F.lower("nullable") == "enable", F.lit(False)).alias("nullable"), F.col("langversion").alias("lang_version"),
    )


def package_table(projects: DataFrame, central: DataFrame | None = None) -> DataFrame:
    """(path, package, version): a reference's own version, or that of the nearest central file above."""
    refs = project_items(projects).where("item = 'package'").select("path", F.col("key").alias("package"), "value")
    if central is None:
        return refs.withColumnRenamed("value", "version")
    theirs = paths.inherited(projects, project_items(central).where("item = 'version'").select("path", "key", "value", "ord"))
    theirs = theirs.select("path", F.col("key").alias("__k"), F.col("value").alias("__v"))
    joined = refs.withColumn("__k", F.lower("package")).join(theirs, ["path", "__k"], "left")
    return joined.select("path", "package", F.coalesce("value", "__v").alias("version"))


_ASSETS = "struct<targets: map<string, map<string, struct<type: string, compile: map<string, map<string, string>>>>>, packageFolders: map<string, map<string, string>>>"


def asset_libraries(assets: DataFrame, framework: str, existing: DataFrame | None = None) -> DataFrame:
    """(path, package, version, file) of the libraries that restored packages give a framework.

    assets is (path, content) of assets files. The target that is or begins with the framework counts,
    whatever the case, else the first. existing lists files; of several package folders the first that
    has a library counts, without it the first.
    """
    a = assets.select("path", F.from_json("content", _ASSETS).alias("a")).where("a is not null")
    targets = F.map_entries("a.targets")
    fits = F.filter(targets, lambda t: X.slashes(F.lower(t["key"])).startswith(framework.lower()))
    chosen = a.withColumn("t", F.coalesce(F.get(fits, F.lit(0)), F.get(targets, F.lit(0)))).withColumn("folders", F.map_keys("a.packageFolders"))
    package = chosen.select("path", "folders", F.explode("t.value").alias("name", "body"))
    file = package.select("path", "folders", "name", F.explode(F.map_keys("body.compile")).alias("dll")).where("dll like '%.dll' and dll not like '%/\\_.\\_'")
    place = file.select("path", F.split_part("name", F.lit("/"), F.lit(1)).alias("package"), F.split_part("name", F.lit("/"), F.lit(2)).alias("version"), "dll", F.posexplode("folders").alias("n", "folder"))
    place = place.withColumn("file", F.concat(F.regexp_replace("folder", "[/\\\\]+$", ""), F.lit("/"), F.lower("package"), F.lit("/"), "version", F.lit("/"), "dll"))
    if existing is not None:
        place = place.join(existing.select(F.col("path").alias("file")), "file", "left_semi")
    return place.groupBy("path", "package", "version", "dll").agg(F.min_by("file", "n").alias("file")).drop("dll")
