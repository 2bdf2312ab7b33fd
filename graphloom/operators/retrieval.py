"""Hybrid retrieval: query model, candidate sources, rank fusion, boosts and demotions, per-file cap, explanation.

A candidate is a row: a node with what its sources say of it. Rules are (signal, condition, weight) with conditions as
Column expressions; those whose words the query lacks are left out when the plan is built, so a plan has only the rules
a question can meet. Nothing here looks at a row on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.operators.symbols import FINDABLE, flag
from graphloom.sources.durable import cut

# Weights, words and patterns that ranked results depend on.
#: Weights of the candidate sources in the fusion.
WEIGHTS = {"semantic": 1.2, "lexical": 1.5, "symbol": 2.0, "graph": 1.5, "path": 2.2, "test": 1.4, "test_pair": 1.3}
#: Words that name no symbol.
STOP_WORDS = ("where", "which", "from", "this", "that", "codebase", "implementation", "source", "module", "called", "calls", "callers", "files", "import", "imports")
TESTS, CODE = ("test", "tests", "spec"), ("implementation", "source", "real")
#: Words that tell of a flow through an application.
FLOW = ("api", "auth", "database", "editor", "middleware", "mutation", "page", "payment", "permissions", "prisma", "response", "route", "service", "survey", "webhook", "workspace")
#: The first intent of which every group has a word in the query; ``broad`` if none.
INTENTS = (
    ("implementation", (("not",), TESTS, CODE)),
    ("test", ((*TESTS, "suite"),)),
    ("app-flow", (("route",), ("api", "handler", "mutation", "server", "wired"))),
    ("app-flow", (FLOW,)),
    ("caller", (("where",), ("called",))),
    ("caller", (("caller", "callers", "calls", "usage", "uses"),)),
    ("imports", (("import", "imports", "imported", "importing"),)),
    ("callee", (("callee", "callees", "called"),)),
    ("implementation", (("implementation", "implemented", "source", "handler"),)),
)
UI_WORDS = ("angular", "builder", "react", "component", "components", "page", "dashboard", "form", "table", "tui", "terminal", "hook", "ui")
GATEWAY_WORDS = ("gateway", "websocket", "rpc", "request", "session", "composer")
SURFACE_WORDS = ("angular", "component", "dashboard", "form", "gateway", "hook", "page", "rpc", "table", "terminal", "tui", "websocket")
SIDE_EFFECT_WORDS = ("polyfill", "module", "evaluation", "load", "loads")
EXPANSION_WORDS = ("route", "api", "mutation", "database", "middleware")
PATH_WORDS = ("api", "auth", "database", "editor", "handler", "middleware", "payment", "permissions", "prisma", "response", "route", "service", "survey", "test", "webhook", "workspace")
NOT_COVERED = ("then", "from", "with", "into", "this", "that")
ROUTE_FILE = r"/routes?/|/api/|/route\.[cm]?[jt]sx?$"
UI_FILE = r"(^|/)(libs|packages)/ui/|/components?/|/app/|\.component\.[cm]?[jt]sx?$|\.tsx$"
NAMED = ("Function", "Class", "Interface", "TypeAlias", "Symbol", "Chunk", "Test")
#: Edges that make candidates of a symbol's neighbours: kind and whether the neighbour is at the from end.
GRAPH_EDGES = (("CALLS", True), ("CALLS", False), ("REFERENCES", True), ("IMPORTS", True), ("EXPORTS", True), ("TESTS", True), ("TESTS", False), ("MENTIONS", True))


@dataclass(frozen=True)
class QueryModel:
    raw: str
    intent: str
    words: tuple[str, ...]
    code_tokens: tuple[str, ...]
    symbol_tokens: tuple[str, ...]

    def has(self, *words: str) -> bool:
        return any(w in self.words for w in words)


def query_model(raw: str) -> QueryModel:
    """What a query asks for, told from its words; made once a query, on the driver."""
    identifiers = re.findall(r"[a-zA-Z_$][a-zA-Z0-9_$]*", raw)
    words = [w.lower() for w in identifiers if len(w) > 2]
    upper = lambda w: w[:1].upper() + w[1:]
    exact = [w for w in identifiers if len(w) >= 4 and re.search(r"[A-Z0-9_$]", w)]
    code = exact + ["".join([run[0], *map(upper, run[1:])]) for n in (2, 3) for run in (words[i : i + n] for i in range(len(words) - n + 1))]
    if "app" in words and {"route", "handler", "api"} & set(words):
        code.append("app")
    if "gateway" in words:
        code.append("gatewayClient")
    if "hook" in words:
        code += [f"use{upper(w)}{end}" for w in words if len(w) >= 4 and w not in ("hook", "hooks") for end in ("", "State")]
    code = list(dict.fromkeys(w for w in code if w == "app" or len(w) >= 4))[:32]
    named = [w for w in words if len(w) >= 4 and w not in STOP_WORDS]
    return QueryModel(raw, intent(words), tuple(words), tuple(code), tuple(dict.fromkeys([*exact, *code, *named]))[:40])


def intent(words: list[str]) -> str:
    have = set(words)
    return next((name for name, groups in INTENTS if all(have.intersection(g) for g in groups)), "broad")


def intent_column(words: Column) -> Column:
    """The same for a column of word arrays."""
    out = None
    for name, groups in INTENTS:
        fits = F.lit(True)
        for g in groups:
            fits = fits & F.arrays_overlap(words, F.array(*[F.lit(w) for w in g]))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("broad")


def passes(node_filters: dict[str, str | None]) -> Column:
    """Keeps nodes of a repo, package_name, file_kind or symbol_kind; filters left out or empty keep all."""
    keep = F.lit(True)
    for column, wanted in node_filters.items():
        if wanted:
            keep = keep & F.coalesce(F.col(column) == wanted, F.lit(False))
    return keep


def is_test() -> Column:
    return F.coalesce(F.col("file_kind") == "test", F.lit(False)) | (F.col("kind") == "Test") | F.coalesce(F.col("file").rlike(r"\.(test|spec)\.[cm]?[jt]sx?$"), F.lit(False))


def kind_rank() -> Column:
    """Order of kinds among equal scores."""
    return F.when(F.col("kind") == "Function", 0).when(F.col("kind").isin("Class", "Symbol"), 1).when(F.col("kind") == "File", 2).when(F.col("kind") == "Chunk", 3).when(F.col("kind") == "Test", 4).otherwise(5)


# ---- candidates -----------------------------------------------------------------------------------------------------


def lexical(nodes: DataFrame, model: QueryModel) -> DataFrame:
    """Nodes that have a word or code token of the query, with ``lexical`` (score) and ``matched`` (the first eight terms).

    The text searched is put together once a row: exploding it keeps Spark from writing it out again for each word.
    """
    text = F.struct(F.lower(F.concat_ws(" ", "file", "name", "kind", "package_name", "symbol_kind", "qualified_name")).alias("_hay"), F.lower("name").alias("_n"))
    hay = nodes.select("*", F.explode(F.array(text)).alias("_h")).select(*nodes.columns, "_h._hay", "_h._n")
    points, terms = F.lit(0.0), []
    for w in model.words:
        points = points + flag(F.col("_hay").contains(w), 0.04 if len(w) <= 3 else 0.08)
        terms.append(F.when(F.col("_hay").contains(w), F.lit(w)))
    for c in model.code_tokens:
        has = F.col("_hay").contains(c.lower())
        points = points + F.when(F.col("_n") == c.lower(), 0.42).when(has, 0.14).otherwise(0.0)
        terms.append(F.when(has | (F.col("_n") == c.lower()), F.lit(c)))
    if not terms:
        return nodes.limit(0).withColumn("lexical", F.lit(0.0)).withColumn("matched", F.array().cast("array<string>"))
    scored = hay.withColumn("lexical", F.round(points, 6)).filter("lexical > 0")
    return scored.withColumn("matched", F.slice(F.array_distinct(F.array_compact(F.array(*terms))), 1, 8)).drop("_hay", "_n")


def top(rows: DataFrame, order: list[Column], limit: int, source: str) -> DataFrame:
    """(id, source, rank) of the first rows in the order, then by id."""
    order = [*order, F.col("id")]
    best = rows.orderBy(*order).limit(limit)
    return best.select("id", F.lit(source).alias("source"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def top_lexical(rows: DataFrame, limit: int = 120, source: str = "lexical") -> DataFrame:
    return top(rows, [F.col("lexical").desc(), kind_rank(), F.coalesce("file", F.lit(""))], limit, source)


def best_lexical(rows: DataFrame, limit: int = 120) -> DataFrame:
    """The rows, whole, that ``top_lexical`` ranks: found once, so what is asked of them later doesn't search all nodes again."""
    return cut(rows.orderBy(F.col("lexical").desc(), kind_rank(), F.coalesce("file", F.lit("")), "id").limit(limit))


def named(nodes: DataFrame, model: QueryModel, each: int = 8) -> DataFrame:
    """(id, token, place): for each symbol token, in order, its best matches; one pass over the nodes for all tokens.

    A token's matches are those whose qualified name it is or, where there are none, those whose name or qualified name
    contains it.
    """
    if not model.symbol_tokens:
        return nodes.limit(0).select("id", F.lit(0).alias("token"), F.lit(0).alias("place"))
    lowered = nodes.filter(F.col("kind").isin(*FINDABLE)).select("id", "kind", "file", "name", "file_kind", "origin", "exported", F.lower(F.coalesce("name", F.lit(""))).alias("_n"), F.lower(F.coalesce("qualified_name", F.lit(""))).alias("_q"))
    told = F.array_compact(
        F.array(
            *[
                F.when((F.col("_q") == t) | F.col("_n").contains(t) | F.col("_q").contains(t), F.struct(F.lit(i).alias("token"), F.lit(t).alias("t")))
                for i, t in enumerate(x.lower() for x in model.symbol_tokens)
            ]
        )
    )
    hits = lowered.withColumn("_hit", F.explode(told)).select("*", "_hit.*").withColumn("tier", F.when(F.col("_q") == F.col("t"), 0).otherwise(1))
    backed = F.coalesce(F.col("origin") == "compiler", F.lit(False))
    rank = F.when(F.col("_q") == F.col("t"), 0).when((F.col("_n") == F.col("t")) & backed, 1).when(F.col("_n") == F.col("t"), 2).when(F.col("_q").endswith(F.concat(F.lit("."), "t")), 3).when((F.col("kind") == "Function") & backed, 4).when(F.col("kind") == "Function", 5).otherwise(6)
    order = [F.col("tier"), rank, kind_rank(), F.coalesce("file", F.lit("")), F.col("_n"), F.col("id")]
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(*order))).withColumn("best", F.min("tier").over(Window.partitionBy("token")))
    return ranked.filter((F.col("place") <= each) & (F.col("tier") == F.col("best"))).select("id", "token", "place")


def first_places(rows: DataFrame, order: list[str], source: str) -> DataFrame:
    """(id, source, rank): ids in the order of their first row. Rows are few: those that earlier limits left."""
    first = rows.groupBy("id").agg(F.min(F.struct(*order)).alias("o"))
    return first.select("id", F.lit(source).alias("source"), F.row_number().over(Window.orderBy("o", "id")).alias("rank"))


def edge_weight() -> Column:
    """What a relation adds as a reason."""
    return F.when(F.col("edge_kind") == "MENTIONS", 0.08).otherwise(0.22) + flag(F.col("edge_kind").isin("CALLS", "TESTS"), 0.12) + flag(F.coalesce(F.col("confidence") == "high", F.lit(False)), 0.08) + flag(F.array_contains("evidence", "compiler"), 0.08) + flag(F.array_contains("evidence", "module-resolution"), 0.08)


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, order: list[str], each: int) -> DataFrame:
    """(id, edge_kind, evidence, confidence, spec, place, and the seeds' columns): what ``GRAPH_EDGES`` lead to from the
    seeds (id and ``order`` columns), up to ``each`` a seed key and kind of edge. One pass over the edges."""
    specs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("spec"), F.lit(incoming).alias("incoming")) for i, (k, incoming) in enumerate(GRAPH_EDGES)])
    rows = edges.filter(F.col("kind").isin(*{k for k, _ in GRAPH_EDGES})).select(F.col("kind").alias("edge_kind"), "from_id", "to_id", "confidence", "evidence")
    rows = rows.withColumn("_s", F.explode(F.filter(specs, lambda s: s["k"] == F.col("edge_kind")))).select("*", "_s.spec", "_s.incoming").drop("_s")
    near, far = F.when(F.col("incoming"), F.col("to_id")).otherwise(F.col("from_id")), F.when(F.col("incoming"), F.col("from_id")).otherwise(F.col("to_id"))
    met = rows.withColumn("_near", near).withColumn("id", far).join(seeds.withColumnRenamed("id", "_near"), "_near")
    met = met.join(nodes.select("id", "file", "name"), "id")
    w = Window.partitionBy(*order, "spec").orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), "id", "_near")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each).select("id", "edge_kind", "evidence", "confidence", "spec", "place", *order)


def neighbour_fits(model: QueryModel) -> Column:
    """Whether an edge to a neighbour (edge_kind, evidence) matters to this intent."""
    side = F.array_contains("evidence", "side-effect")
    if model.intent in ("caller", "callee"):
        return side
    fits = side | F.col("edge_kind").isin("REFERENCES", "CALLS")
    if model.intent == "imports":
        fits = fits | (F.col("edge_kind") == "IMPORTS")
    if model.intent == "implementation":
        fits = fits | (F.col("edge_kind") == "TESTS")
    return fits


def adjacent(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(id, edge_kind, evidence, confidence, turn): ends of edges at the seeds, outgoing and incoming in turn."""
    ids = seeds.select(F.col("id").alias("_seed")).distinct()
    rows = edges.select(F.col("kind").alias("edge_kind"), "from_id", "to_id", "confidence", "evidence")
    sides = [rows.withColumn("_seed", F.col(a)).join(ids, "_seed").select(F.col(b).alias("id"), "edge_kind", "evidence", "confidence", F.lit(side).alias("side")) for side, (a, b) in enumerate((("from_id", "to_id"), ("to_id", "from_id")))]
    w = Window.partitionBy("side").orderBy("id", "edge_kind")
    both = sides[0].orderBy("id", "edge_kind").limit(limit).unionByName(sides[1].orderBy("id", "edge_kind").limit(limit))
    first = Window.partitionBy("id").orderBy("turn", "side")
    numbered = both.withColumn("turn", F.row_number().over(w)).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return numbered.orderBy("turn", "side").limit(limit).select("id", "edge_kind", "evidence", "confidence", (F.col("turn") * 2 + F.col("side")).alias("turn"))


def flow_seed_rank(model: QueryModel) -> Column:
    """Which candidates an application flow starts from, lower first."""
    path, name = F.lower(F.coalesce("file", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    rank = F.lit(100)
    for asked, fits, points in (
        (("route",), path.rlike(r"/routes?/|/api/"), 35),
        (("mutation",), path.contains("mutation") | name.contains("mutation"), 30),
        (("mutation",), path.contains("/api-core/"), 18),
        (("api", "server"), path.contains("apps/api/"), 25),
        (("database", "mutation"), path.contains("database") | (name == "prisma"), 20),
    ):
        if model.has(*asked):
            rank = rank - flag(fits, points)
    tests = F.coalesce(F.col("file_kind") == "test", F.lit(False)) | path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")
    return rank + flag(tests, 40) + flag(path.contains("/packages/ui/"), 15) + flag(F.col("kind") == "File", 6) + flag(F.col("kind") == "Chunk", 4)


def expands_flow(model: QueryModel) -> bool:
    return model.intent == "app-flow" or model.has(*EXPANSION_WORDS)


def test_candidates(lex: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, pairs) as (id, source, rank): the best test nodes by words, and source nodes of the files they are paired
    with by name, in the order of the tests."""
    tests = best_lexical(lex.filter(is_test()), 50)
    ranked = top_lexical(tests, 50, "test")
    paired = F.regexp_replace("file", r"\.(test|spec)(\.[cm]?[jt]sx?)$", "$2")
    asked = ranked.join(tests.select("id", "file"), "id").withColumn("_pair", paired).filter(F.col("_pair") != F.col("file")).groupBy("_pair").agg(F.min("rank").alias("rank"))
    sources = nodes.filter("file_kind = 'source'").select("id", "file")
    found = sources.join(asked, F.col("file") == F.col("_pair")).select("id", "rank")
    return ranked, first_places(found, ["rank"], "test_pair")


def fused(candidates: DataFrame) -> DataFrame:
    """(id, fusion, sources): weighted reciprocal ranks, a source counting with its best rank."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    best = candidates.groupBy("id", "source").agg(F.min("rank").alias("rank"))
    share = weight[F.col("source")].cast("double") / (60 + F.col("rank"))
    names = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", F.col("rank").cast("string")))), ",")
    return best.groupBy("id").agg((18 * F.sum(share)).alias("fusion"), names.alias("sources"))


def normalized(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score / 4)), 6)


# ---- rules ----------------------------------------------------------------------------------------------------------

Rule = tuple[str, Column, "Column | float"]


def _p() -> Column:
    return F.lower(F.coalesce("file", F.lit("")))


def _n() -> Column:
    return F.lower(F.coalesce("name", F.lit("")))


def exact_symbol(model: QueryModel) -> Column:
    if not model.symbol_tokens:
        return F.lit(False)
    return F.coalesce(F.lower("name").isin(sorted({s.lower() for s in model.symbol_tokens})), F.lit(False)) & F.col("kind").isin(*NAMED)


def primary_symbol() -> Column:
    """Whether a symbol bears the name of its file."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^[^a-zA-Z_$]+", ""), r"[^a-zA-Z0-9_$]|(?<=.)[-_](?=[a-zA-Z0-9_$])", ""))
    stem = plain(F.regexp_replace(F.substring_index("file", "/", -1), r"(\.test|\.spec|\.stories)?\.[cm]?[jt]sx?$", ""))
    return F.coalesce(F.col("kind").isin("Function", "Class", "Symbol", "Chunk") & (stem != "") & (stem == plain(F.col("name"))), F.lit(False))


def boosts(model: QueryModel) -> list[Rule]:
    """What raises a candidate. Columns beside the node's: edge_kinds, evidence (arrays), lexical, matched, paired, path_score."""
    path, name, raw, has = _p(), _n(), F.coalesce("name", F.lit("")), model.has
    kinds = lambda *k: F.col("kind").isin(*k)
    edge = lambda k: F.array_contains("edge_kinds", k)
    told = lambda e: F.array_contains("evidence", e)
    on_route = path.rlike(ROUTE_FILE)
    out: list[Rule] = [
        ("symbol_exact", exact_symbol(model), 1.1),
        ("evidence_compiler", told("compiler"), 0.25),
        ("evidence_module_resolution", told("module-resolution"), 0.22),
        ("evidence_test_context", told("test-syntax"), 0.2),
        ("edge_calls", edge("CALLS"), 0.22),
        ("edge_tests", edge("TESTS"), 0.22),
        ("edge_module_boundary", edge("IMPORTS") | edge("EXPORTS"), 0.16),
        ("evidence_side_effect", told("side-effect"), 0.44),
        ("path_app_flow", F.col("path_score").isNotNull(), F.least(F.lit(2.1), F.greatest(F.lit(0.25), F.col("path_score") / 2.4))),
    ]
    if model.intent == "implementation":
        both = F.size(F.filter("matched", lambda w: (F.length(w) >= 4) & path.contains(w) & name.contains(w)))
        out += [
            ("intent_implementation", F.col("file_kind") == "source", 0.7),
            ("implementation_symbol_kind", kinds("Function", "Class", "Symbol"), 0.28),
            ("implementation_primary_file_symbol", primary_symbol(), 0.9),
            ("implementation_path_name_match", F.coalesce(both, F.lit(0)) > 0, F.least(both * 0.18, F.lit(0.54))),
        ]
    if model.intent == "test":
        out += [("intent_test", is_test(), 0.68), ("test_to_implementation_pair", F.col("paired"), 0.48)]
    if model.intent in ("caller", "callee"):
        runs = kinds("Function", "Symbol") if model.intent == "caller" else F.lit(False)
        out += [
            (f"intent_{model.intent}", edge("CALLS"), 0.55),
            ("caller_executable_candidate", edge("CALLS") & runs, 0.55),
            ("caller_source_candidate" if model.intent == "caller" else "callee_target_candidate", edge("CALLS") & ~runs & kinds("Function", "Class", "Chunk", "File"), 0.3),
        ]
    if model.intent == "imports":
        out += [("intent_imports_edge", edge("IMPORTS"), 0.72), ("imports_file_candidate", kinds("File", "Chunk"), 0.24)]
    if model.intent == "app-flow":
        owner = kinds("File") & on_route
        database = has("database", "record", "db", "prisma") or (has("mutation") and has("call"))
        for asked, signal, fits, points in (
            (has("route"), "app_flow_route", path.rlike(r"/routes?/|/api/"), 1.0),
            (has("route"), "app_flow_route_owner_file", owner, 1.05),
            (has("prisma"), "app_flow_database_route_owner", owner & F.col("path_score").isNotNull(), 0.95),
            (has("route") and has("handler") and has("wired"), "app_flow_route_wiring_file", owner, 0.75),
            (has("mutation", "create", "delete"), "app_flow_mutation", path.contains("mutation"), 0.9),
            (has("mutation", "call"), "app_flow_api_core", path.contains("/api-core/"), 0.48),
            (database, "app_flow_database", path.contains("database") | (name == "prisma"), 1.3),
            (True, "app_flow_mutation_to_database", told("mutation-to-database"), 1.4),
            (has("middleware"), "app_flow_middleware", path.contains("middleware"), 0.26),
            (has("ui", "page"), "app_flow_ui", path.contains("/app/") | path.endswith(".tsx"), 0.24),
        ):
            if asked:
                out.append((signal, fits, points))
    hook_words = [w for w in model.words if len(w) >= 4 and w not in ("hook", "hooks", "terminal", "tui")]
    in_domain = F.lit(False)
    for w in hook_words:
        in_domain = in_domain | path.contains(w) | name.contains(w)
    both_names = F.concat_ws(" ", path, name)
    page = kinds("Function") & (raw == "Page") & F.coalesce(F.col("file").rlike(r"(^|/)(app|pages|modules)/.*/page\.[cm]?[jt]sx?$"), F.lit(False))
    for asked, signal, fits, points in (
        (has(*UI_WORDS), "surface_ui", path.rlike(UI_FILE) | name.rlike("component|page|hook"), 0.46),
        (has("builder") and has("link"), "surface_link_builder", path.rlike("/ui/links?/"), 1.65),
        (has("builder"), "surface_builder_hook", raw.rlike("^use[A-Z]"), 0.85),
        (has("hook"), "surface_hook_domain", raw.rlike("^use[A-Z]") & in_domain, 0.86),
        (has("angular"), "surface_angular_component", path.rlike(r"\.component\.[cm]?[jt]sx?$"), 0.88),
        (has("table"), "surface_table", path.contains("table") | name.contains("table"), 0.42),
        (has("page", "dashboard", "form", "editor"), "surface_page_symbol", page, 0.95),
        (has(*GATEWAY_WORDS), "surface_gateway_client", both_names.rlike("gateway|client|rpc|websocket"), 0.58),
        (has(*GATEWAY_WORDS), "surface_client_class", kinds("Class") & name.contains("client"), 0.98),
        (has(*SIDE_EFFECT_WORDS), "side_effect_edge", told("side-effect"), 1.35),
        (has(*SIDE_EFFECT_WORDS), "side_effect_path", path.contains("side-effect"), 1.75),
        (has("private"), "path_private", path.contains("private"), 0.38),
        (has("web"), "path_web_app", path.contains("apps/web"), 0.24),
        (has("api"), "path_api", path.contains("/api/"), 0.24),
        (has("route"), "path_route", path.rlike(r"(^|/)(routes?|route)\b|\[\.\.\.route\]"), 0.22),
        (has("dashboard"), "path_dashboard", path.contains("dashboard"), 0.62),
    ):
        if asked:
            out.append((signal, fits, points))
    covered = [w for w in model.words if len(w) >= 4 and w not in NOT_COVERED]
    if len(covered) >= 2:
        n = sum((flag(path.contains(w) | name.contains(w), 1) for w in covered), F.lit(0))
        out.append(("path_word_coverage", n >= 2, F.least(n * 0.14, F.lit(0.84))))
        out.append(("path_symbol_coverage", (n >= 3) & kinds("Function", "Class"), 0.28))
    return out


def demotions(model: QueryModel) -> list[Rule]:
    """What lowers a candidate."""
    path, name, has = _p(), _n(), model.has
    exact, test = exact_symbol(model), is_test()
    calls = F.array_contains("edge_kinds", "CALLS")
    out: list[Rule] = [
        ("weak_mentions_only", F.coalesce((F.size("edge_kinds") == 1) & F.array_contains("edge_kinds", "MENTIONS"), F.lit(False)), 0.45),
        ("generated_or_vendor", path.contains("/node_modules/") | path.contains("/dist/") | path.contains("/generated/"), 0.6),
        ("import_export_wrapper", F.col("kind").isin("Import", "Export"), 0.48),
    ]
    unpaired = ~F.col("paired")
    for asked, signal, fits, points in (
        (model.intent == "implementation", "implementation_demotes_tests", test, 0.72),
        (model.intent != "test", "non_test_intent_demotes_tests", test, 0.62),
        (model.intent in ("caller", "callee"), "relationship_intent_demotes_tests", test, 0.28),
        (model.intent == "caller", "relationship_intent_demotes_seed_symbol", exact, 2.2),
        (model.intent == "callee", "relationship_intent_demotes_seed_symbol", exact & ~F.coalesce(calls, F.lit(False)), 0.82),
        (model.intent == "imports", "imports_intent_demotes_seed_symbol", exact, 1.1),
        (not has("story", "stories", "storybook"), "storybook_non_story_query", path.rlike(r"\.stories\.[cm]?[jt]sx?$"), 0.64),
        (not has("schema"), "schema_helper", name.rlike("(schema|params|input)$"), 0.72 if model.intent == "app-flow" else 0.18),
        (model.intent == "test", "test_intent_keeps_paired_source_below_tests", (F.col("file_kind") == "source") & F.col("paired"), 0.38),
        (model.intent == "test", "test_intent_demotes_unpaired_source", (F.col("file_kind") == "source") & unpaired, 0.22),
        (has("not") and has(*TESTS), "negative_test_intent", test, 1.15),
        (model.intent == "app-flow" and not has("ui", "page", "component"), "app_flow_demotes_generic_ui", path.contains("/packages/ui/"), 0.55),
        (model.intent == "app-flow", "app_flow_demotes_unowned_value_symbol", (F.col("kind") == "Symbol") & ~F.coalesce(F.array_contains("evidence", "mutation-to-database"), F.lit(False)) & ~name.rlike("prisma|database|db|client"), 1.85),
    ):
        if asked:
            out.append((signal, fits, points))
    return out


def weighed(rules: list[Rule]) -> Column:
    """The rules that hold, as an array of (signal, weight)."""
    parts = [F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(signal).alias("signal"), (F.lit(w) if isinstance(w, float) else w).cast("double").alias("weight"))) for signal, fits, w in rules]
    return F.array_compact(F.array(*parts))


def total(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(0.0), lambda a, r: a + r["weight"])


def top_reasons(reasons: Column) -> Column:
    """The twelve weightiest, then by signal, with weights of six decimals."""
    by = F.transform(reasons, lambda r: F.struct((-F.round(r["weight"], 6)).alias("w"), r["signal"].alias("signal")))
    return F.transform(F.slice(F.array_sort(by), 1, 12), lambda r: F.struct(r["signal"].alias("signal"), (-r["w"]).alias("weight")))


def scored(nodes: DataFrame, candidates: DataFrame, model: QueryModel, relations: DataFrame | None = None, lex: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Candidates fused, boosted and demoted, with ``reasons`` and ``demoted`` (arrays of signal and weight).

    candidates: (id, source, rank). relations: (id, edge_kind, evidence, direct): edges that led to a candidate, direct
    if not by a path. lex: (id, lexical, matched) of the lexical candidates. paths: (id, path_score, paths).
    """
    rows = F.broadcast(cut(fused(candidates))).join(nodes, "id")  # candidates are few: all sources have limits
    none = F.array().cast("array<string>")
    if relations is None:
        rows = rows.withColumn("edge_kinds", none).withColumn("evidence", none).withColumn("graph_calls", F.lit(False))
    else:
        each = relations.withColumn("_e", F.explode_outer("evidence"))
        met = each.groupBy("id").agg(F.collect_set("edge_kind").alias("edge_kinds"), F.collect_set("_e").alias("evidence"), F.max((F.col("edge_kind") == "CALLS") & F.col("direct")).alias("graph_calls"))
        rows = rows.join(met, "id", "left").withColumn("edge_kinds", F.coalesce("edge_kinds", none)).withColumn("evidence", F.coalesce("evidence", none)).withColumn("graph_calls", F.coalesce("graph_calls", F.lit(False)))
    if lex is None:
        rows = rows.withColumn("lexical", F.lit(0.0)).withColumn("matched", none)
    else:
        by_words = candidates.filter("source = 'lexical'").select("id").distinct()
        rows = rows.join(lex.join(by_words, "id", "left_semi").select("id", "lexical", "matched"), "id", "left")
    if paths is None:
        rows = rows.withColumn("path_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(paths, "id", "left")
    rows = rows.withColumn("paired", F.col("sources").contains("test_pair="))
    rows = rows.withColumn("reasons", weighed(boosts(model))).withColumn("demoted", weighed(demotions(model)))
    words = F.least(F.coalesce("lexical", F.lit(0.0)), F.lit(0.6))
    rows = rows.withColumn("boost", F.round(total(F.col("reasons")) + words, 6)).withColumn("demotion", F.round(total(F.col("demoted")), 6))
    return rows.withColumn("score", F.round(F.col("fusion") + F.col("boost") - F.col("demotion"), 6))


def hybrid(nodes: DataFrame, candidates: DataFrame, model: QueryModel, limit: int, relations: DataFrame | None = None, lex: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """``scored`` candidates, capped per file and cut, with the twelve weightiest parts of each score."""
    rows = scored(nodes, candidates, model, relations, lex, paths)
    order = [F.col("score").desc(), kind_rank(), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), F.col("id")]
    kept = capped(rows, model, order).orderBy(*order).limit(limit)
    return kept.withColumn("reasons", top_reasons(F.col("reasons"))).withColumn("demoted", top_reasons(F.col("demoted")))


def capped(rows: DataFrame, model: QueryModel, order: list[Column]) -> DataFrame:
    """At most so many rows a file, taken in order; rows without a file all stay.

    Some questions allow 3 or 4. Otherwise a row allows 2 of its file if it is an exact symbol, paired with a test or
    reached by a call, else 1: the first row stays, and the first later one that allows 2.
    """
    most = 3 if model.has(*SURFACE_WORDS) else 4 if model.intent in ("caller", "callee", "imports") else None
    key = F.coalesce("file", F.concat(F.lit("\0"), "id"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if most:
        return rows.filter(F.col("_n") <= most).drop("_n")
    allows = exact_symbol(model) | F.col("paired") | F.col("graph_calls")
    later = (F.col("_n") > 1) & allows
    rows = rows.withColumn("_later", later).withColumn("_m", F.row_number().over(Window.partitionBy(key, "_later").orderBy("_n")))
    return rows.filter((F.col("_n") == 1) | (F.col("_later") & (F.col("_m") == 1))).drop("_n", "_m", "_later")


def overlap(text: Column, words: list[str]) -> Column:
    """How many of the words are among a text's tokens."""
    return F.size(F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in words])))

