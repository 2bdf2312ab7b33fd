"""Queries over a fixed source tree: extraction, resolution, graph building, diagnostics and evaluation. Their SQL states
the known answers as values, since nothing of them is in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import building, chunking, diagnostics, evaluation, linking, modules
from graphloom.operators.extraction import extract_facts
from graphloom.plans.registry import query
from graphloom.sources import workspace
from graphloom.sources.durable import cut
from graphloom.sources.graph_views import Tables

TREE = {
    "package.json": '{"name": "root", "dependencies": {"react": "1"}}',
    "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["./packages/core/src/*"], /* one */ "@sum": ["packages/core/src/sum.ts"],}}}',
    "packages/core/package.json": '{"name": "@s/core", "exports": {".": {"require": "./src/old.js", "import": "./src/index.ts"}, "./math/*": "./src/*.ts", "./gone": "./src/gone.ts"}}',
    "packages/core/src/index.ts": "export * from './sum';\nexport { Store as Shop } from './store';\n",
    "packages/core/src/sum.ts": "export function total(xs: number[]): number {\n  return xs.length;\n}\nexport default total;\n",
    "packages/core/src/store.ts": "import { total } from './sum';\nexport interface Item { id: string }\nexport class Store {\n  add(item: Item) { return this.count([item]); }\n  count(items: Item[]) { return total(items); }\n  static open() { return new Store(); }\n}\n",
    "apps/web/package.json": '{"name": "web"}',
    "apps/web/app/api/orders/[id]/route.ts": "import { Shop } from '@s/core';\nimport { total } from '@s/core/math/sum';\nexport async function GET(request: Request) { return total([]); }\nexport async function POST() { return Shop.open(); }\n",
    "apps/web/src/cart.ts": "import { Store, Item } from '@lib/store';\nimport sum from '@sum';\nimport * as core from '@s/core';\nimport gone from '@s/core/gone';\nimport React from 'react';\nimport './polyfill';\nexport type Line = Item | Store;\nexport class Cart {\n  constructor(private store: Store) {}\n  put(item: Item) { this.store.add(item); return sum([core.total([])]); }\n}\nexport const load = (name: string) => import(`./pages/${name}`);\n",
    "apps/web/src/polyfill.ts": "export const ready = process.env.READY;\n",
    "apps/web/src/pages/home.ts": "export const home = 1;\n",
    "apps/web/src/cart.test.ts": "import { Cart } from './cart';\nvi.mock('./polyfill');\ndescribe('cart', () => {\n  it('puts', () => { expect(new Cart()).toMatchSnapshot(); });\n  it('asks', async () => { await api.get('/orders/7?x=1'); });\n});\n",
    "apps/web/src/pages/home.spec.ts": "test('stands', () => {});\n",
    "node_modules/react/index.js": "module.exports = {};\n",
    "apps/web/dist/cart.js": "x",
}


def tree(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, facts, settings) of the fixed tree."""
    raw = t.spark.createDataFrame([(p, len(x), bytearray(x.encode())) for p, x in TREE.items()], "path string, bytes long, content binary").withColumn("modified", F.lit(None).cast("timestamp"))
    files = workspace.discovered(raw)
    return files, extract_facts(files.filter("reason = 'included'")), raw.filter(F.col("path").rlike(r"(^|/)(package|[tj]sconfig)\.json$"))


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    files, facts, settings = tree(t)
    return building.assembled(files, cut(facts), settings)


def values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows."""
    show = lambda v: "NULL" if v is None else repr(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({columns})"


CORE, WEB = "packages/core/src", "apps/web/src"


@query(values("path, package, reason", ("package.json", "root", "unsupported-extension"), (f"{CORE}/sum.ts", "@s/core", "included"), (f"{WEB}/cart.ts", "web", "included"), ("node_modules/react/index.js", "root", "build-artifact"), ("apps/web/dist/cart.js", "web", "build-artifact")))
def tree_discovery(t: Tables) -> DataFrame:
    """Why files are in or out and whose they are, for one file of each sort."""
    some = ["package.json", f"{CORE}/sum.ts", f"{WEB}/cart.ts", "node_modules/react/index.js", "apps/web/dist/cart.js"]
    return tree(t)[0].filter(F.col("path").isin(some)).select("path", F.col("package_name").alias("package"), "reason")


@query(values("name, declared_as, parent, line", ("Store", "class", None, 3), ("Item", "interface", None, 2), ("add", "method", "Store", 4), ("count", "method", "Store", 5), ("open", "method", "Store", 6)))
def tree_declarations(t: Tables) -> DataFrame:
    return building.declared(tree(t)[1]).filter(F.col("path") == f"{CORE}/store.ts").select("name", "declared_as", "parent", "line")


@query(
    values(
        "specifier, target, status, why",
        ("@lib/store", f"{CORE}/store.ts", "alias", None),
        ("@sum", f"{CORE}/sum.ts", "alias", None),
        ("@s/core", f"{CORE}/index.ts", "workspace", None),
        ("@s/core/gone", None, "unresolved", "unresolved-package-export"),
        ("react", None, "external", "external-package"),
        ("./polyfill", f"{WEB}/polyfill.ts", "relative", None),
        ("./pages/${name}", None, "unresolved", "unresolved-module"),
    )
)
def tree_resolution(t: Tables) -> DataFrame:
    """Where one file's specifiers lead, and why not."""
    files, facts, settings = tree(t)
    rows = building.resolve_modules(facts, files, workspace.packages(settings), modules.package_exports(settings), modules.path_aliases(settings))
    return rows.filter(F.col("path") == f"{WEB}/cart.ts").select("specifier", "target", "status", "why")


@query(values("package_name, export_name, target", ("@s/core", ".", "./src/index.ts"), ("@s/core", "./gone", "./src/gone.ts"), ("@s/core", "./math/*", "./src/*.ts")))
def tree_package_exports(t: Tables) -> DataFrame:
    return modules.package_exports(tree(t)[2]).select("package_name", "export_name", "target")


def _short(column: str) -> F.Column:
    return F.element_at(F.split(F.regexp_replace(column, r":\d+$", ""), "[#/]"), -1)


def _edges(t: Tables, *kinds: str) -> DataFrame:
    return graph(t)[1].filter(F.col("kind").isin(*kinds)).select("kind", _short("from_id").alias("a"), _short("to_id").alias("b"), F.array_join("evidence", ",").alias("evidence"))


_RESOLVED = "call-syntax,module-resolution"


@query(
    values(
        "kind, a, b, evidence",
        ("CALLS", "count", "total", _RESOLVED),
        ("CALLS", "add", "count", "call-syntax,member-call-syntax"),
        ("CALLS", "open", "Store", "call-syntax"),
        ("CALLS", "GET", "total", _RESOLVED),
        ("CALLS", "POST", "open", "call-syntax,static-member-call"),
        ("CALLS", "put", "add", "call-syntax,injected-member-call"),
        ("CALLS", "put", "total", _RESOLVED),
    )
)
def tree_calls(t: Tables) -> DataFrame:
    """Calls by name, through imports, namespaces, classes, this and injected members."""
    return _edges(t, "CALLS")


@query(
    values(
        "kind, a, b, evidence",
        ("TESTS", "cart.test.ts", "Cart", "import-syntax,snapshot-syntax,test-syntax"),
        ("TESTS", "cart.test.ts", "GET", "http-route,test-syntax"),
        ("TESTS", "cart.test.ts", "polyfill.ts", "mock-syntax,test-syntax"),
        ("TESTS", "cart.test.ts", "ready", "mock-syntax,test-syntax"),
        ("TESTS", "cart.test.ts", "cart.ts", "snapshot-syntax,test-syntax"),
        ("TESTS", "home.spec.ts", "home.ts", "colocated-test-name"),
    )
)
def tree_tests(t: Tables) -> DataFrame:
    """Tests linked by import, route, mock, snapshot and name."""
    return _edges(t, "TESTS")


@query(
    values(
        "kind, a, b, evidence",
        ("REFERENCES", "add", "Item", "type-use"),
        ("REFERENCES", "count", "Item", "type-use"),
        ("REFERENCES", "Line", "Item", "discriminated-union,type-use"),
        ("REFERENCES", "Line", "Store", "discriminated-union,type-use"),
        ("REFERENCES", "Cart", "Store", "type-use"),
        ("REFERENCES", "put", "Item", "type-use"),
        ("REFERENCES", "polyfill.ts", "env:READY", "config-env,member-access"),
    )
)
def tree_references(t: Tables) -> DataFrame:
    """Types used, members of unions, environment variables."""
    return _edges(t, "REFERENCES")


@query(
    values(
        "kind, a, b, evidence",
        ("IMPORTS", "cart.ts", "polyfill.ts", "import-syntax,module-resolution,side-effect"),
        ("IMPORTS", "cart.ts", "home.ts", "dynamic-template,import-syntax"),
        ("IMPORTS", "route.ts", "Store", "import-syntax,module-resolution"),
        ("EXPORTS", "index.ts", "Store", "export-syntax,module-resolution"),
    )
)
def tree_module_edges(t: Tables) -> DataFrame:
    """Imports for effects, of a template and through a renaming re-export, and the re-export itself."""
    rows = _edges(t, "IMPORTS", "EXPORTS")
    return rows.filter("(a = 'cart.ts' AND b IN ('polyfill.ts', 'home.ts')) OR (a = 'route.ts' AND b = 'Store') OR a = 'index.ts' AND b = 'Store'")


@query(values("line, method, url, name, case_", (5, "GET", "/orders/7", "GET", "asks")))
def tree_route_requests(t: Tables) -> DataFrame:
    """Requests of tests with the handlers they reach and the test case around them."""
    files, facts, _ = tree(t)
    tests = files.filter("file_kind = 'test'").select("path")
    met = linking.by_route(linking.route_targets(files.filter("reason = 'included'"), building.declared(facts)), linking.requests(facts, tests))
    told = linking.with_case(met, linking.cases(facts))
    return told.select("line", "method", "url", _short("id").alias("name"), F.col("case").alias("case_"))


@query(values("name, part, start_line, end_line, tokens, oversized", ("Store part 1", 1, 3, 5, 17, False), ("Store part 2", 2, 6, 7, 6, False)))
def tree_chunk_pieces(t: Tables) -> DataFrame:
    """A class as pieces of at most 20 tokens."""
    files, facts, _ = tree(t)
    owned = building.declared(facts).filter("name = 'Store'").join(files.select("path", "text"), "path")
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    chunks = owned.select("id", "name", "kind", lines.alias("content"), F.col("line").alias("start_line"))
    return chunking.split_chunks(chunks, 20).select("name", "part", "start_line", "end_line", "tokens", "oversized")


@query(values("path, status, reason", (f"{CORE}/sum.ts", "indexed", "included"), ("node_modules/react/index.js", "skipped", "build-artifact"), (f"{WEB}/pages/home.spec.ts", "indexed", "included")))
def tree_lifecycles(t: Tables) -> DataFrame:
    files, facts, settings = tree(t)
    nodes, edges = building.assembled(files, cut(facts), settings)
    told = diagnostics.lifecycles(files, facts, nodes, edges)
    return told.filter(F.col("path").isin(f"{CORE}/sum.ts", "node_modules/react/index.js", f"{WEB}/pages/home.spec.ts")).select("path", "status", "reason")


@query(values("a, b, hops", ("cart.test.ts", "add", 2), ("cart.test.ts", "total", 2)))
def tree_indirect_tests(t: Tables) -> DataFrame:
    """What a test's direct targets call, through the class's method; one step goes from the class to what it defines."""
    nodes, edges = graph(t)
    direct = edges.filter("kind = 'TESTS' AND array_contains(evidence, 'import-syntax')").select("from_id", "to_id")
    inside = edges.filter("kind = 'CALLS'").unionByName(_members(nodes, edges))
    return linking.indirect(direct, inside).select(_short("from_id").alias("a"), _short("to_id").alias("b"), "hops")


def _members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with their methods, as references."""
    parts = F.split("qualified_name", "[.]")
    own = nodes.filter("kind = 'Function'").filter(F.size(parts) == 3).select("file", F.get(parts, F.lit(1)).alias("owner"), F.col("id").alias("to_id"))
    classes = nodes.filter("kind = 'Class'").select("file", F.col("name").alias("owner"), F.col("id").alias("from_id"))
    made = own.join(classes, ["file", "owner"])
    return made.select(*[F.lit("REFERENCES").alias("kind") if c == "kind" else F.col(c) if c in ("from_id", "to_id") else F.lit(None).cast(k).alias(c) for c, k in edges.dtypes])


@query(values("id, status, failure_class, mrr, recall, ndcg", ("calls", "pass", None, 1.0, 1.0, 1.0), ("late", "fail", "ranking", 0.5, 1.0, 0.63093), ("none", "fail", "query", 0.0, 0.0, 0.0), ("unwanted", "fail", "ranking", 0.0, 1.0, 1.0)))
def tree_evaluation(t: Tables) -> DataFrame:
    """Cases over symbol lookups in the tree: found, found too late, not found, found though unwanted."""
    nodes, _ = graph(t)
    told = nodes.filter("name IN ('total', 'Store')").select("file", F.col("name").alias("symbol"), "kind").distinct()
    ranked = told.filter("kind IN ('Function', 'Class')").select("file", "symbol", "kind", F.when(F.col("symbol") == "total", 1).otherwise(2).alias("rank"))
    ids = t.spark.createDataFrame([(i,) for i in ("calls", "late", "none", "unwanted")], "id string")
    row = lambda i, wanted, file, symbol, most=None: (i, i, "find-symbol", symbol, 10, "lookup", "query", "required", None, wanted, 1, file, symbol, None, most)
    cases = t.spark.createDataFrame([row("calls", True, "**/sum.ts", "total", 1), row("late", True, f"{CORE}/store.ts", "Store", 1), row("none", True, "x.ts", "nothing"), row("unwanted", False, f"{CORE}/*.ts", "Store")], evaluation.CASE)
    results = evaluation.case_results(evaluation.ranked_expectations(cases, ids.join(ranked)))
    return results.select("id", "status", "failure_class", "mrr", "recall", "ndcg")
