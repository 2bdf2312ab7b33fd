"""Where module specifiers lead: package exports with conditions and patterns, path aliases, and re-exports.

Exports and aliases come from a few JSON files, parsed in one Arrow pass over those alone; resolving is a join of the
specifiers, as lists of candidate files in order of preference, with the files there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import package_of
from graphloom.sources.durable import cut
from graphloom.sources.workspace import EXTENSIONS, parse_jsonc

#: Conditions of an export in the order in which they are tried.
CONDITIONS = ("types", "import", "default", "require", "node")


def conditional_target(value: object) -> str | None:
    """The file an export stands for: a string, or the first condition that has one."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((t for c in CONDITIONS if (t := conditional_target(value.get(c)))), None)
    return None


def export_entries(exports: object) -> list[tuple[str, str | None]]:
    """(name, target) of a package's exports; a string, or conditions alone, are the package itself."""
    if isinstance(exports, str):
        return [(".", exports)]
    if not isinstance(exports, dict):
        return []
    named = [(k, conditional_target(v)) for k, v in exports.items() if k.startswith(".")]
    return sorted(named) if named else [(".", conditional_target(exports))]


def _parsed(files: DataFrame, entries, shape: str) -> DataFrame:
    """entries(folder, document) of JSON files (path, content); files that don't parse have none."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    document = parse_jsonc((content or b"").decode("utf-8", "replace"))
                except ValueError:
                    continue
                if isinstance(document, dict):
                    rows += entries(path.rpartition("/")[0], document)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return files.select("path", "content").mapInArrow(run, shape)


def package_exports(files: DataFrame) -> DataFrame:
    """(folder, package_name, export_name, target) of every package.json that has exports."""
    of = lambda folder, d: [(folder, d.get("name") or folder.rpartition("/")[2] or "root", name, target) for name, target in export_entries(d.get("exports"))]
    found = files.filter(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").rlike("(^|/)node_modules/"))
    return _parsed(found, of, "folder string, package_name string, export_name string, target string")


def path_aliases(files: DataFrame) -> DataFrame:
    """(folder, pattern, target) of the paths in each tsconfig.json and jsconfig.json, targets from the root."""

    def of(folder: str, document: dict) -> list[tuple]:
        options = document.get("compilerOptions")
        options = options if isinstance(options, dict) else {}
        base = "/".join(x for x in (folder, str(options.get("baseUrl", ".")).removeprefix("./").strip("/")) if x and x != ".")
        paths = options.get("paths")
        return [(folder, pattern, "/".join(x for x in (base, target.removeprefix("./")) if x)) for pattern, targets in (paths.items() if isinstance(paths, dict) else ()) for target in targets if isinstance(target, str)]

    return _parsed(files.filter(F.col("path").rlike(r"(^|/)[tj]sconfig\.json$")), of, "folder string, pattern string, target string")


def matches_pattern(pattern: Column, name: Column) -> Column:
    """What a pattern's star stands for in a name (empty for a pattern without one), null if it doesn't fit."""
    star = F.instr(pattern, "*")
    before, after = F.substr(pattern, F.lit(1), star - 1), F.substr(pattern, star + 1)
    inside = F.substr(name, star, F.length(name) - F.length(before) - F.length(after))
    fits = name.startswith(before) & name.endswith(after) & (F.length(name) >= F.length(before) + F.length(after))
    return F.when(star == 0, F.when(pattern == name, "")).when(fits, inside)


def probes(at: Column) -> Column:
    """Files a path without certainty may mean: itself, with an extension, an index file in it."""
    bare = F.regexp_replace(F.regexp_replace(at, "^\\./", ""), r"\.(d\.)?[cm]?[jt]sx?$", "")
    folder = F.regexp_replace(bare, "/$", "")
    return F.concat(F.array(F.regexp_replace(at, "^\\./", "")), F.array(*[F.concat(bare, F.lit(f".{e}")) for e in EXTENSIONS]), F.array(*[F.concat(folder, F.lit(f"/index.{e}")) for e in EXTENSIONS]))


def first_file(asked: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, candidates: paths in order) -> (keys, target): the first candidate that is a file."""
    each = asked.select(*keys, F.posexplode("candidates").alias("place", "probe")).select(*keys, "place", F.explode(F.transform(probes(F.col("probe")), lambda p, i: F.struct(i.alias("i"), p.alias("p")))).alias("q"))
    there = files.select(F.col("path").alias("target"))
    hit = each.join(there, F.col("q.p") == F.col("target"))
    return hit.groupBy(*keys).agg(F.min(F.struct("place", F.col("q.i").alias("i"), "target")).alias("m")).select(*keys, F.col("m.target").alias("target"))


def aliased(asked: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """asked (path, specifier) that a path alias of the nearest configuration above the importer leads to a file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    placed = asked.select("path", "specifier", F.explode(above).alias("folder"))
    near = placed.join(aliases.select("folder").distinct(), "folder", "left_semi").groupBy("path", "specifier").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    fit = near.join(aliases, "folder").withColumn("star", matches_pattern(F.col("pattern"), F.col("specifier"))).filter("star is not null")
    order = F.struct((-F.length("pattern")).alias("o"), F.replace("target", F.lit("*"), F.col("star")).alias("t"))
    tried = fit.groupBy("path", "specifier").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]).alias("candidates"))
    return first_file(tried, files, ["path", "specifier"])


def packaged(asked: DataFrame, exports: DataFrame, named: DataFrame, files: DataFrame) -> DataFrame:
    """asked (path, specifier) of packages of this tree -> (path, specifier, target, package, export_name, how, why).

    An export of that name, then one whose pattern fits, leads to its file. A package without such an export has its
    index file, or the file of the subpath. ``why`` says why there is no target.
    """
    keys = ["path", "specifier"]
    inside = asked.filter(~F.col("specifier").rlike(r"^[./]")).withColumn("package", package_of(F.col("specifier"))).join(named.select(F.col("package_name").alias("package"), "folder"), "package")
    rest = F.regexp_replace(F.substr("specifier", F.length("package") + 1), "^/", "")
    inside = inside.withColumn("export_name", F.when(rest == "", ".").otherwise(F.concat(F.lit("./"), rest)))
    shown = exports.filter("target is not null").select(F.col("package_name").alias("package"), F.col("export_name").alias("shown"), F.col("target").alias("to"))
    fit = inside.join(shown, "package").withColumn("star", matches_pattern(F.col("shown"), F.col("export_name"))).filter("star is not null")
    exact = F.struct((F.instr("shown", "*") > 0).alias("late"), (-F.length("shown")).alias("o"), F.when(F.instr("shown", "*") > 0, F.replace("to", F.lit("*"), F.col("star"))).otherwise(F.col("to")).alias("to"))
    told = fit.groupBy(*keys).agg(F.min(exact).alias("m")).select(*keys, F.col("m.to").alias("to"))
    joined = inside.join(told, keys, "left")
    at = lambda sub: F.concat_ws("/", F.nullif("folder", F.lit("")), sub)
    plain = F.regexp_replace(F.col("to"), r"^\./", "")
    own = F.when(F.col("export_name") == ".", F.array(at(F.lit("src/index")), at(F.lit("index")))).otherwise(F.array(at(F.substr("export_name", F.lit(3)))))
    starred = F.coalesce(F.instr("to", "*") > 0, F.lit(False))
    tried = joined.withColumn("candidates", F.when(F.col("to").isNull(), own).when(starred, F.array().cast("array<string>")).otherwise(F.array(at(plain))))
    found = first_file(tried, files, keys)
    why = F.when(F.col("target").isNotNull(), None).when(starred, "pattern-package-export").otherwise("unresolved-package-export")
    return joined.join(found, keys, "left").select(*keys, "target", "package", "export_name", F.when(F.col("to").isNull(), "package-subpath").otherwise("package-exports").alias("how"), why.alias("why"))


def through_exports(asked: DataFrame, exports: DataFrame, declared: DataFrame) -> DataFrame:
    """asked (target: a module, there: a name) -> (target, there, symbol): the symbol the name stands for, through any
    number of named and star re-exports, never in a circle. A declaration wins over a re-export, a named one over a star.

    exports: (path, name, local, target) of re-exports, star for all names; declared: (path, name, symbol).
    """
    own = declared.select(F.col("path").alias("at"), F.col("name").alias("as"), "symbol")
    stars = exports.filter("name = '*'").select(F.col("path").alias("at"), F.col("target").alias("next")).distinct()
    named = exports.filter("name <> '*'").select(F.col("path").alias("at"), F.col("name").alias("as"), F.col("target").alias("next"), F.col("local").alias("next_as")).distinct()
    front = asked.select("target", "there", F.col("target").alias("at"), F.col("there").alias("as"), F.lit("").alias("way")).distinct()
    seen, found, hop = front.select("target", "there", "at", "as"), None, 0
    while True:
        hit = front.join(own, ["at", "as"]).select("target", "there", "symbol", F.lit(hop).alias("hop"), "way")
        found = hit if found is None else found.unionByName(hit)
        by_name = front.join(named, ["at", "as"]).select("target", "there", F.col("next").alias("at"), F.col("next_as").alias("as"), F.concat("way", F.lit("0")).alias("way"))
        by_star = front.filter(F.col("as") != "default").join(stars, "at").select("target", "there", F.col("next").alias("at"), "as", F.concat("way", F.lit("1")).alias("way"))
        step = by_name.unionByName(by_star).groupBy("target", "there", "at", "as").agg(F.min("way").alias("way"))
        front = cut(step.join(seen, ["target", "there", "at", "as"], "left_anti"))
        if front.isEmpty():
            break
        seen, hop = seen.unionByName(front.select("target", "there", "at", "as")), hop + 1
    w = Window.partitionBy("target", "there").orderBy("hop", "way", "symbol")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("target", "there", "symbol")
