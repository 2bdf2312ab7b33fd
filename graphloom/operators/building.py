"""From a source tree to a graph: module resolution, symbols and chunks, and edges that say what they rest on.

Every step is a join of fact tables. Edges of all steps are merged by (kind, from, to) at the end: the last step's
scalars win, evidence is united. ``facts`` has the columns of ``extraction``, ``files`` those of ``workspace.discover``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import http_path, module_stem
from graphloom.operators import linking, modules
from graphloom.operators.changes import merged_edges, snapshot_diff
from graphloom.operators.extraction import contained, extract_facts
from graphloom.sources.durable import cut
from graphloom.sources.graph_views import NODE_COLUMNS
from graphloom.sources.workspace import Policy, discover, packages, scan

#: Kinds of declarations as kinds of nodes.
KINDS = {"function": "Function", "class": "Class", "interface": "Interface", "type": "TypeAlias", "enum": "Symbol", "namespace": "Symbol", "variable": "Symbol", "method": "Function", "enum-member": "Symbol"}


def joined_path(importer: Column, specifier: Column) -> Column:
    """A relative specifier as a path from the root, with . and .. worked off."""
    folder = F.regexp_replace(importer, r"/?[^/]*$", "")
    parts = F.split(F.concat_ws("/", folder, specifier), "/")
    none = F.array().cast("array<string>")
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, none, step), "/")


def resolve_modules(facts: DataFrame, files: DataFrame, named: DataFrame, exports: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, target, status, why): each specifier by the first way that finds something.

    relative: the path itself, with an extension, or an index file in it; alias: a path alias of the nearest
    configuration; workspace: a package of this tree, by its exports or else its files; external: another package;
    unresolved: the rest, and why. An ambient module's name leads to the file that declares it.
    """
    asked = facts.filter("kind IN ('import', 'export') AND specifier IS NOT NULL").select("path", "specifier")
    asked = asked.unionByName(facts.filter("kind = 'call' AND argument IS NOT NULL").filter(F.col("specifier").isin("vi.mock", "jest.mock")).select("path", F.col("argument").alias("specifier"))).distinct()
    sources = files.filter("reason = 'included'")
    keys = ["path", "specifier"]
    relative = asked.filter(F.col("specifier").rlike(r"^\.")).withColumn("candidates", F.array(joined_path(F.col("path"), F.col("specifier"))))
    parts = [modules.first_file(relative, sources, keys).withColumn("how", F.lit("relative")).withColumn("place", F.lit(0))]
    bare = asked.filter(~F.col("specifier").rlike(r"^[.]"))
    if aliases is not None:
        parts.append(modules.aliased(bare, aliases, sources).withColumn("how", F.lit("alias")).withColumn("place", F.lit(1)))
    none = named.select(F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("export_name"), F.lit(None).cast("string").alias("target")).limit(0)
    inside = modules.packaged(bare, none if exports is None else exports, named, sources)
    parts.append(inside.filter("target is not null").select(*keys, "target", F.lit("workspace").alias("how"), F.lit(2).alias("place")))
    ambient = facts.filter("kind = 'ambient'").groupBy("specifier").agg(F.min("path").alias("target"))
    parts.append(bare.join(ambient, "specifier").select(*keys, "target", F.lit("ambient").alias("how"), F.lit(3).alias("place")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy(*keys).agg(F.min(F.struct("place", "target", "how")).alias("m")).select(*keys, F.col("m.target").alias("target"), F.col("m.how").alias("how"))
    failed = inside.filter("target is null").select(*keys, "why")
    known = F.col("how").isNotNull()
    status = F.when(known, F.col("how")).when(F.col("why").isNotNull() | F.col("specifier").rlike(r"^[./]"), "unresolved").otherwise("external")
    joined = asked.join(found, keys, "left").join(failed, keys, "left")
    why = F.when(known, None).when(F.col("why").isNotNull(), F.col("why")).when(F.col("specifier").rlike(r"^[./]"), "unresolved-module").otherwise("external-package")
    return joined.select(*keys, "target", status.alias("status"), why.alias("why"))


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), name, F.lit(":"), line.cast("string"))


def declared(facts: DataFrame) -> DataFrame:
    """(id, path, name, kind, exported, line, end_line, parent, declared_as): one symbol per declaration; a name's first
    stands for it. Methods and members of enums have a parent."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = facts.filter("kind = 'declaration'")
    return rows.select(symbol_id(F.col("path"), F.col("name"), F.col("line")).alias("id"), "path", "name", kinds[F.col("detail")].alias("kind"), "exported", "line", "end_line", F.col("specifier").alias("parent"), F.col("detail").alias("declared_as"))


def graph_nodes(files: DataFrame, symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Packages, files, symbols, a chunk of source per function or class, and environment variables."""

    def shaped(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(*[columns.get(c, F.lit(None)).cast("boolean" if c == "exported" else "string").alias(c) for c in NODE_COLUMNS])

    kept = files.filter("reason = 'included'")
    place = kept.select(F.col("path").alias("fp"), "package_name", "file_kind", "text")
    owned = symbols.join(place, F.col("path") == F.col("fp"))
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    parts = [
        shaped(kept.select("package_name").distinct().filter("package_name is not null"), id=F.concat(F.lit("package:"), "package_name"), kind=F.lit("Package"), package_name=F.col("package_name"), name=F.col("package_name")),
        shaped(kept, id=F.concat(F.lit("file:"), "path"), kind=F.lit("File"), package_name=F.col("package_name"), file=F.col("path"), name=F.substring_index("path", "/", -1), file_kind=F.col("file_kind")),
        shaped(owned, id=F.col("id"), kind=F.col("kind"), package_name=F.col("package_name"), file=F.col("path"), name=F.col("name"), file_kind=F.col("file_kind"), symbol_kind=F.col("kind"), qualified_name=F.concat_ws(".", module_stem(F.substring_index("path", "/", -1)), F.when(F.col("declared_as") == "method", F.col("parent")), "name"), exported=F.col("exported"), origin=F.lit("syntax")),
        shaped(owned.filter("kind IN ('Function', 'Class')"), id=F.concat(F.lit("chunk:"), "id"), kind=F.lit("Chunk"), package_name=F.col("package_name"), file=F.col("path"), name=F.col("name"), file_kind=F.col("file_kind"), content=lines),
        shaped(facts.filter("kind = 'member' AND detail = 'env'").select("name").distinct(), id=F.concat(F.lit("env:"), "name"), kind=F.lit("Symbol"), name=F.col("name"), symbol_kind=F.lit("EnvVar")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(files: DataFrame, facts: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """All edges, merged: containment, definitions, imports, exports, calls, heritage, tests, environment."""
    steps: list[DataFrame] = []

    def add(df: DataFrame, kind: str, a: Column, b: Column, origin: str, confidence: str | None, evidence: list[str], owner: Column) -> None:
        made = df.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit(origin).alias("origin"), F.lit(confidence).cast("string").alias("confidence"), F.array(*[F.lit(e) for e in sorted(evidence)]).cast("array<string>").alias("evidence"), owner.alias("owner_file"), F.lit(len(steps)).alias("seq"))
        steps.append(made.filter("from_id is not null AND to_id is not null AND from_id <> to_id"))

    file_id = lambda c: F.concat(F.lit("file:"), F.col(c))
    kept = files.filter("reason = 'included'").select("path", "package_name", "file_kind")
    add(kept, "CONTAINS", F.concat(F.lit("package:"), "package_name"), file_id("path"), "tree", None, [], F.col("path"))
    add(symbols, "DEFINES", file_id("path"), F.col("id"), "syntax", None, [], F.col("path"))
    add(symbols.filter("kind IN ('Function', 'Class')"), "HAS_CHUNK", F.col("id"), F.concat(F.lit("chunk:"), "id"), "syntax", None, [], F.col("path"))
    add(symbols.filter("exported"), "EXPORTS", file_id("path"), F.col("id"), "syntax", "high", ["export-syntax"], F.col("path"))
    targets = resolved.filter("target is not null")
    add(targets, "IMPORTS", file_id("path"), file_id("target"), "resolver", "fallback", ["import-syntax", "module-resolution"], F.col("path"))

    # an imported name stands for the target's symbol of that name, a default import for its exported default or only export
    first = Window.partitionBy("path", "name").orderBy("line")
    top = symbols.filter("declared_as <> 'method'").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    by_name = top.select("path", "name", F.col("id").alias("symbol"))
    imports = facts.filter("kind = 'import' AND name is not null").select("path", "specifier", F.col("name").alias("local"), F.regexp_replace("detail", "^type:", "").alias("imported"))
    defaults = facts.filter("kind = 'export' AND name = 'default' AND detail is not null AND specifier is null").select(F.col("path").alias("target"), F.col("detail").alias("default_name"))
    asked = imports.join(targets.select("path", "specifier", "target"), ["path", "specifier"]).join(defaults, "target", "left")
    there = F.when(F.col("imported") == "default", F.coalesce("default_name", "local")).when(F.col("imported") == "require", F.col("local")).otherwise(F.col("imported"))
    asked = asked.withColumn("there", there)
    onward = facts.filter("kind = 'export' AND specifier is not null").join(targets.select("path", "specifier", "target"), ["path", "specifier"]).select("path", "name", F.when(F.col("name") == "*", "*").otherwise(F.regexp_replace("detail", "^type:", "")).alias("local"), "target")
    names = modules.through_exports(asked.filter("imported <> '*'").select("target", "there"), onward, by_name)
    bound = asked.join(names, ["target", "there"]).select("path", "local", "symbol", "target")
    add(bound, "IMPORTS", file_id("path"), F.col("symbol"), "resolver", "medium", ["import-syntax", "module-resolution"], F.col("path"))
    shown = modules.through_exports(onward.filter("name <> '*'").select(F.col("target"), F.col("local").alias("there")), onward, by_name)
    add(onward.filter("name <> '*'").join(shown, (onward["target"] == shown["target"]) & (onward["local"] == shown["there"])).select("path", "symbol"), "EXPORTS", file_id("path"), F.col("symbol"), "resolver", "medium", ["export-syntax", "module-resolution"], F.col("path"))

    # imports by what they do: for their effects alone, of all files a template may name
    effects = facts.filter("kind = 'import' AND detail = 'side-effect'").join(targets, ["path", "specifier"])
    add(effects, "IMPORTS", file_id("path"), file_id("target"), "resolver", "high", ["import-syntax", "side-effect"], F.col("path"))
    templates = facts.filter("kind = 'import' AND detail = 'dynamic'").filter(F.col("specifier").contains("${") & F.col("specifier").startswith("."))
    pattern = F.regexp_replace(joined_path(F.col("path"), F.regexp_replace("specifier", r"\$\{[^}]*\}", "\u0001")), "([.+()\\[\\]^$|])", r"\\$1")
    named_by = templates.select(F.col("path").alias("importer"), F.concat(F.lit("^"), F.replace(pattern, F.lit("\u0001"), F.lit("[^/]*")), F.lit(r"(\.[cm]?[jt]sx?)?$")).alias("pattern"), F.substring_index(joined_path(F.col("path"), "specifier"), "${", 1).alias("start"))
    folder_of = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    met = named_by.withColumn("folder", folder_of(F.col("start"))).join(kept.select("path").withColumn("folder", folder_of(F.col("path"))), "folder").filter("path RLIKE pattern AND path <> importer")
    add(met, "IMPORTS", file_id("importer"), file_id("path"), "resolver", "fallback", ["dynamic-template", "import-syntax"], F.col("importer"))

    def found_calls(rows: DataFrame, evidence: list[str], confidence: str, origin: str = "resolver") -> None:
        add(rows, "CALLS", F.col("caller"), F.col("symbol"), origin, confidence, evidence, F.col("path"))

    calls = contained(facts).withColumn("caller", symbol_id(F.col("path"), F.col("owner"), F.col("owner_line")))
    calls = calls.join(symbols.select(F.col("id").alias("caller"), F.col("parent").alias("caller_parent")), "caller")
    local = by_name.select("path", F.col("name").alias("callee"), "symbol")
    found_calls(calls.filter("callee = callee_path").join(local, ["path", "callee"]), ["call-syntax"], "medium", "syntax")
    found_calls(calls.filter("callee = callee_path").withColumn("local", F.col("callee")).join(bound, ["path", "local"]), ["call-syntax", "module-resolution"], "high")
    # a.b(): of a namespace the module's b, of a class its method b, of an object what the object was imported as
    dotted = calls.filter("callee <> callee_path").withColumn("local", F.substring_index("callee_path", ".", 1)).withColumn("depth", F.size(F.split("callee_path", "[.]")))
    spaces = asked.filter("imported = '*'").select("path", "local", "target")
    of_spaces = dotted.filter("depth = 2").join(spaces, ["path", "local"])
    inner = modules.through_exports(of_spaces.select("target", F.col("callee").alias("there")), onward, by_name)
    found_calls(of_spaces.join(inner, (of_spaces["target"] == inner["target"]) & (of_spaces["callee"] == inner["there"])).select("caller", "symbol", "path"), ["call-syntax", "module-resolution"], "high")
    methods = symbols.filter("declared_as = 'method'").select(F.col("path").alias("_p"), F.col("parent").alias("_c"), F.col("name").alias("callee"), F.col("id").alias("symbol"))
    classes = symbols.filter("kind = 'Class'").select(F.col("id").alias("class_id"), F.col("path").alias("_p"), F.col("name").alias("_c"))
    known = bound.select("path", "local", F.col("symbol").alias("class_id")).unionByName(by_name.select("path", F.col("name").alias("local"), F.col("symbol").alias("class_id"))).join(classes, "class_id")
    found_calls(dotted.filter("depth = 2").join(known, ["path", "local"]).join(methods, ["_p", "_c", "callee"]), ["call-syntax", "static-member-call"], "high")
    own = dotted.filter("depth = 2 AND local = 'this' AND caller_parent IS NOT NULL").select("caller", "path", "callee", F.col("path").alias("_p"), F.col("caller_parent").alias("_c"))
    found_calls(own.join(methods, ["_p", "_c", "callee"]), ["call-syntax", "member-call-syntax"], "high")
    injected = facts.filter("kind = 'injected'").select("path", F.col("specifier").alias("caller_parent"), F.col("name").alias("field"), F.col("detail").alias("local"))
    through = dotted.filter("depth = 3 AND local = 'this'").withColumn("field", F.split("callee_path", "[.]")[1]).drop("local").join(injected, ["path", "caller_parent", "field"]).join(known, ["path", "local"])
    found_calls(through.join(methods, ["_p", "_c", "callee"]), ["call-syntax", "injected-member-call"], "medium")
    objects = dotted.filter("local <> 'this'").join(bound, ["path", "local"]).join(classes.select(F.col("class_id").alias("symbol")), "symbol", "left_anti")
    found_calls(objects, ["call-syntax", "module-resolution"], "high")

    # a type's name leads to an interface, alias, class or enum, of this file or imported
    types = top.filter("kind IN ('Interface', 'TypeAlias', 'Class') OR declared_as = 'enum'").select(F.col("id").alias("symbol"))
    visible = bound.select("path", "local", "symbol").unionByName(by_name.select("path", F.col("name").alias("local"), "symbol")).join(types, "symbol", "left_semi")
    around = symbols.select("path", F.col("id").alias("caller"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    used = facts.filter("kind = 'type'").select("path", F.col("name").alias("local"), "line").join(around, "path").filter("line >= a AND line <= b")
    used = used.groupBy("path", "local", "line").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("s"), "caller"))["caller"].alias("caller"))
    add(used.join(visible, ["path", "local"]), "REFERENCES", F.col("caller"), F.col("symbol"), "syntax", "medium", ["type-use"], F.col("path"))
    unions = facts.filter("kind = 'union'").select("path", F.col("name").alias("owner"), F.col("specifier").alias("local")).join(by_name.select("path", F.col("name").alias("owner"), F.col("symbol").alias("caller")), ["path", "owner"])
    add(unions.join(visible, ["path", "local"]), "REFERENCES", F.col("caller"), F.col("symbol"), "syntax", "medium", ["discriminated-union", "type-use"], F.col("path"))
    heritage = facts.filter("kind = 'heritage'").select("path", F.col("name").alias("owner"), "detail", F.col("specifier").alias("local")).join(by_name.select("path", F.col("name").alias("owner"), F.col("symbol").alias("caller")), ["path", "owner"])
    parents = bound.select("path", "local", "symbol").unionByName(by_name.select("path", F.col("name").alias("local"), "symbol"))
    for how in ("extends", "implements"):
        add(heritage.filter(F.col("detail") == how).join(parents, ["path", "local"]), how.upper(), F.col("caller"), F.col("symbol"), "syntax", "high", ["type-relationship"], F.col("path"))

    tests = kept.filter("file_kind = 'test'").select("path")
    direct = bound.join(tests, "path", "left_semi").select("path", "symbol", "target")
    add(direct, "TESTS", file_id("path"), F.col("symbol"), "resolver", "high", ["import-syntax", "test-syntax"], F.col("path"))
    routes = linking.route_targets(kept, top)
    add(linking.by_route(routes, linking.requests(facts, tests)), "TESTS", file_id("path"), F.col("id"), "route", "medium", ["http-route", "test-syntax"], F.col("path"))
    mocked = linking.mocks(facts, targets, tests)
    add(mocked, "TESTS", file_id("path"), file_id("target"), "mock", "medium", ["mock-syntax", "test-syntax"], F.col("path"))
    add(mocked.join(top.filter("exported").select(F.col("path").alias("target"), F.col("id").alias("symbol")), "target"), "TESTS", file_id("path"), F.col("symbol"), "mock", "medium", ["mock-syntax", "test-syntax"], F.col("path"))
    snaps = linking.snapshots(facts, bound, tests)
    add(snaps, "TESTS", file_id("path"), F.col("symbol"), "snapshot", "medium", ["snapshot-syntax", "test-syntax"], F.col("path"))
    add(snaps, "TESTS", file_id("path"), file_id("target"), "snapshot", "medium", ["snapshot-syntax", "test-syntax"], F.col("path"))
    beside = linking.colocated(tests.join(direct.select("path").distinct(), "path", "left_anti"), kept.filter("file_kind = 'source'"))
    add(beside, "TESTS", file_id("path"), file_id("source"), "colocated", "fallback", ["colocated-test-name"], F.col("path"))
    # calls of an application's own routes, by path
    client = facts.filter("kind = 'call' AND argument LIKE '/%'").join(tests, "path", "left_anti").select("path", "line", F.when(F.col("name").rlike(linking.METHOD_PATTERN), F.upper("name")).otherwise("GET").alias("method"), http_path(F.col("argument")).alias("url"))
    add(linking.by_route(routes, client).filter("path <> target_file"), "REFERENCES", file_id("path"), F.col("id"), "route", "medium", ["api-client-call", "http-route"], F.col("path"))
    env = facts.filter("kind = 'member' AND detail = 'env'")
    add(env, "REFERENCES", file_id("path"), F.concat(F.lit("env:"), "name"), "syntax", "medium", ["config-env", "member-access"], F.col("path"))

    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    owners = out.groupBy("kind", "from_id", "to_id").agg(F.max_by("owner_file", "seq").alias("owner_file"))
    return merged_edges(out).join(owners, ["kind", "from_id", "to_id"]).withColumn("repo", F.lit(None).cast("string"))


def index_workspace(spark: SparkSession, root: str, policy: Policy = Policy(), known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, files, facts) of a tree. ``known`` is (files, facts) of an earlier run: unchanged files keep theirs."""
    files = cut(discover(spark, root, policy))  # one state of the tree for all that follows
    sources = files.filter("reason = 'included'")
    if known is None:
        facts = extract_facts(sources)
    else:
        diff = snapshot_diff(known[0].filter("reason = 'included'"), sources, "path", "content_hash")
        fresh = sources.join(diff.filter("status IN ('added', 'changed')"), "path", "left_semi")
        facts = known[1].join(diff.filter("status = 'unchanged'"), "path", "left_semi").unionByName(extract_facts(fresh))
    facts = cut(facts)  # read by every step below
    settings = scan(spark, root).filter(F.col("path").rlike(r"(^|/)(package|[tj]sconfig)\.json$"))
    return *assembled(files, facts, settings), files, facts


def assembled(files: DataFrame, facts: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of discovered files, their facts, and the JSON files (path, content) that say how modules resolve."""
    symbols = cut(declared(facts))
    resolved = cut(resolve_modules(facts, files, packages(settings), modules.package_exports(settings), modules.path_aliases(settings)))
    return graph_nodes(files, symbols, facts), graph_edges(files, facts, symbols, resolved)
