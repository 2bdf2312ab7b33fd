"""Candidates by paths: short scored ways from the nodes a question names, and the owners of the files it leads to.

Frontiers are joined hop by hop over edges of the kinds below; scores of nodes and edges are columns, so the only
per-seed state is the row of a partial path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.retrieval import PATH_WORDS, ROUTE_FILE, QueryModel, is_test, kind_rank
from graphloom.operators.symbols import flag

# What edges, evidence, confidence and roles add to a path's score.
EDGE_POINTS = {"CALLS": 0.72, "TESTS": 0.62, "REFERENCES": 0.44, "IMPORTS": 0.28, "EXPORTS": 0.28, "MENTIONS": 0.04}
EVIDENCE_POINTS = {"compiler": 0.38, "module-resolution": 0.34, "call-syntax": 0.28, "member-call-syntax": 0.28, "test-syntax": 0.22, "indirect-test": 0.16}
OTHER_SYNTAX = 0.14
CONFIDENCE_POINTS = {"high": 0.28, "medium": 0.16, "fallback": -0.18}
ROLE_POINTS = {"route": 0.9, "page": 0.66, "service": 0.52, "database": 0.52, "middleware": 0.42, "test": 0.4, "executable": 0.34, "file": 0.12}
COVERAGE, PER_EDGE, OWNER, INCOMING, FALLBACK, UNRESOLVED, WEAK_MENTION = 0.14, 0.1, 1.25, 0.08, 0.22, 0.42, 0.5
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def applies(model: QueryModel) -> bool:
    return model.intent in ("app-flow", "test") or model.has(*PATH_WORDS)


def _mapped(values: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], F.lit(0.0))


def route_handler() -> Column:
    return F.coalesce((F.col("kind") == "Function") & F.col("name").isin(*METHODS) & F.col("file").rlike(r"/api/|/route\.[cm]?[jt]sx?$"), F.lit(False))


def route_owner() -> Column:
    return F.coalesce((F.col("kind") == "File") & F.col("file").rlike(ROUTE_FILE), F.lit(False))


def page_node() -> Column:
    return F.coalesce((F.col("kind") == "Function") & F.col("name").rlike("Page$") & F.col("file").rlike(r"(^|/)(app|pages|modules)/.*\.[cm]?[jt]sx?$"), F.lit(False))


def concepts(model: QueryModel) -> Column:
    """The words of four letters or more that a node's names contain."""
    hay = F.lower(F.concat_ws(" ", "file", "name", "kind", "package_name", "qualified_name"))
    words = list(dict.fromkeys(w for w in model.words if len(w) >= 4))
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hay, w))


def role(model: QueryModel) -> Column:
    """What a node is worth on a path by the part it plays."""
    both = F.lower(F.concat_ws(" ", F.coalesce("file", F.lit("")), F.coalesce("name", F.lit(""))))
    score = flag(route_handler() | route_owner(), ROLE_POINTS["route"]) + flag(page_node(), ROLE_POINTS["page"])
    score = score + flag(both.rlike("service|action|mutation|resolver|handler"), ROLE_POINTS["service"])
    score = score + flag(both.rlike("database|prisma|db|client|response"), ROLE_POINTS["database"])
    score = score + flag(both.rlike("middleware"), ROLE_POINTS["middleware"]) + flag(is_test(), ROLE_POINTS["test"])
    score = score + flag(F.col("kind").isin("Function", "Class", "Symbol"), ROLE_POINTS["executable"]) + flag(F.col("kind") == "File", ROLE_POINTS["file"])
    for word, pattern, points in (("webhook", "webhook", 0.36), ("auth", "auth|permission|workspace", 0.32), ("editor", "editor|page", 0.26)):
        if model.has(word):
            score = score + flag((F.lower(F.coalesce("file", F.lit(""))) if word == "webhook" else both).rlike(pattern), points)
    return score


def edge_points(incoming: Column) -> Column:
    """kind, evidence, confidence; if there, fallback_reason and unresolved."""
    told = F.aggregate(F.coalesce("evidence", F.array().cast("array<string>")), F.lit(0.0), lambda a, e: a + F.coalesce(F.create_map(*[F.lit(x) for pair in EVIDENCE_POINTS.items() for x in pair])[e], F.when(e.endswith("-syntax"), OTHER_SYNTAX).otherwise(0.0)))
    return _mapped(EDGE_POINTS, F.col("kind")) + told + _mapped(CONFIDENCE_POINTS, F.coalesce("confidence", F.lit(""))) - flag(incoming, INCOMING) - flag(F.col("kind") == "MENTIONS", WEAK_MENTION)


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges both ways: a, b, edge_kind, told (evidence), points."""
    rows = edges.filter(F.col("kind").isin(*EDGE_POINTS))
    more = F.lit(0.0)
    if "fallback_reason" in edges.columns:
        more = more - flag(F.col("fallback_reason").isNotNull(), FALLBACK)
    if "unresolved" in edges.columns:
        more = more - flag(F.coalesce("unresolved", F.lit(False)), UNRESOLVED)
    ways = F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(False).alias("incoming")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b"), F.lit(True).alias("incoming"))))
    turned = rows.withColumn("_w", ways).select("*", "_w.*").withColumn("points", edge_points(F.col("incoming")) + more)
    return turned.select("a", "b", F.col("kind").alias("edge_kind"), F.col("evidence").alias("told"), "points")


def seeds(nodes: DataFrame, candidates: DataFrame, lex: DataFrame, model: QueryModel, most: int = 48) -> DataFrame:
    """(id, seed): candidates that name a concept of the query, match its words or are near it, and the best by words."""
    near = candidates.filter("source IN ('semantic', 'lexical')").select("id").distinct().withColumn("_by", F.lit(True))
    known = candidates.select("id").distinct().join(near, "id", "left")
    words = lex.orderBy(F.col("lexical").desc(), kind_rank(), F.coalesce("file", F.lit("")), "id").limit(most).select("id").withColumn("_by", F.lit(True))
    every = known.unionByName(words).groupBy("id").agg(F.max("_by").alias("_by"))
    told = nodes.join(every, "id").withColumn("_c", F.size(concepts(model))).filter("_c > 0 OR _by")
    order = [F.col("_c").desc(), kind_rank(), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), F.col("id")]
    return told.orderBy(*order).limit(most).select("id", F.row_number().over(Window.orderBy(*order)).alias("seed"))


def paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, model: QueryModel, depth: int = 3, each: int = 40, beam: int = 4096) -> DataFrame:
    """(seed, place, ids, kinds, evidence, score): the best simple paths of up to ``depth`` edges from each seed.

    A path is useful if one of its edges isn't a mention and it names a concept or has a node that runs. Ways don't go
    on through packages or mentions. Of a seed's partial paths the ``beam`` best go on, as a search that stops would have it.
    """
    told = nodes.select("id", "kind", role(model).alias("role"), concepts(model).alias("concepts"))
    steps = adjacency(edges).join(told.withColumnsRenamed({"id": "b", "kind": "b_kind", "role": "b_role", "concepts": "b_concepts"}), "b")
    now = starts.join(told, "id").select("seed", F.array("id").alias("ids"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<string>").alias("evidence"), F.lit(0.0).alias("edges_score"), F.col("role").alias("roles"), F.col("role").alias("best_role"), "concepts")
    out = None
    for hop in range(1, depth + 1):
        score = F.col("edges_score") + F.col("points") + F.col("roles") + F.col("b_role") + F.size(F.array_union("concepts", "b_concepts")) * COVERAGE - hop * PER_EDGE
        now = now.join(steps, F.element_at("ids", -1) == F.col("a")).filter(~F.array_contains("ids", F.col("b"))).select(
            "seed",
            F.concat("ids", F.array("b")).alias("ids"),
            F.concat("kinds", F.array("edge_kind")).alias("kinds"),
            F.array_union("evidence", F.coalesce("told", F.array().cast("array<string>"))).alias("evidence"),
            (F.col("edges_score") + F.col("points")).alias("edges_score"),
            (F.col("roles") + F.col("b_role")).alias("roles"),
            F.greatest("best_role", "b_role").alias("best_role"),
            F.array_union("concepts", "b_concepts").alias("concepts"),
            F.round(score, 6).alias("score"),
            ((F.col("b_kind") != "Package") & (F.col("edge_kind") != "MENTIONS")).alias("goes_on"),
        )
        useful = now.filter(F.exists("kinds", lambda k: k != "MENTIONS") & ((F.size("concepts") > 0) | (F.col("best_role") >= ROLE_POINTS["executable"])))
        useful = useful.select("seed", "ids", "kinds", "evidence", "concepts", "score")
        out = useful if out is None else out.unionByName(useful)
        order = Window.partitionBy("seed").orderBy(F.col("score").desc(), F.array_join("ids", ">"))
        now = now.filter("goes_on").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= beam).drop("_n", "goes_on", "score")
    once = out.groupBy("seed", "ids").agg(F.max(F.struct("score", "kinds", "evidence", "concepts")).alias("p")).select("seed", "ids", "p.*")
    order = Window.partitionBy("seed").orderBy(F.col("score").desc(), F.size("ids"), F.array_join("ids", ">"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)


def path_candidates(found: DataFrame, nodes: DataFrame, model: QueryModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, relations, explanations) of paths: every node on a path that plays a part or names a concept."""
    numbered = found.withColumn("rank", F.row_number().over(Window.orderBy("seed", "place")))
    on = numbered.select("rank", "score", "kinds", "evidence", "concepts", F.array_join("ids", ">").alias("path"), F.explode("ids").alias("id"))
    told = nodes.filter(~F.col("kind").isin("Import", "Export")).filter((role(model) > 0) | (F.size(concepts(model)) > 0)).select("id")
    on = on.join(told, "id")
    ranks = on.groupBy("id").agg(F.min("rank").alias("rank")).select("id", F.lit("path").alias("source"), "rank")
    met = on.select("id", F.explode(F.array_distinct("kinds")).alias("edge_kind"), "evidence", F.lit(False).alias("direct"))
    reason = F.concat(F.array_join(F.array_distinct("kinds"), ","), F.when(F.size("concepts") > 0, F.concat(F.lit(" matched "), F.array_join(F.slice("concepts", 1, 6), ","))).otherwise(""))
    return ranks, met, explained(on.select("id", "score", reason.alias("reason"), "path"))


def explained(rows: DataFrame) -> DataFrame:
    """(id, path_score, paths): the four best explanations of each id, one per path."""
    w = Window.partitionBy("id", "path").orderBy(F.col("score").desc(), "reason")
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "path")
    top = once.withColumn("_n", F.row_number().over(best)).filter("_n <= 4")
    entry = F.struct((-F.col("score")).alias("s"), "path", "reason")
    packed = top.groupBy("id").agg(F.max("score").alias("path_score"), F.array_sort(F.collect_list(entry)).alias("e"))
    return packed.select("id", "path_score", F.transform("e", lambda e: F.struct((-e["s"]).alias("score"), e["reason"].alias("reason"), e["path"].alias("path"))).alias("paths"))


def owners(nodes: DataFrame, candidates: DataFrame, model: QueryModel) -> tuple[DataFrame, DataFrame]:
    """(candidates, rows to explain): for a candidate that names a concept, the best representative of its file."""
    score = F.round(role(model) + F.size(concepts(model)) * 0.2, 6)
    name = F.coalesce("name", F.lit(""))
    stands = F.col("kind").isin("Function", "Class", "Symbol") & (route_handler() | page_node() | name.rlike("^[A-Z][A-Za-z0-9_$]+$") | name.rlike("^(get|create|update|delete|process|record|use)[A-Z]"))
    asked = nodes.join(candidates.select("id").distinct(), "id").filter(F.col("file").isNotNull() & (F.size(concepts(model)) > 0)).select(F.col("id").alias("asked"), F.col("file").alias("of"))
    first = route_handler() | route_owner() | page_node()
    reps = nodes.filter(stands & F.col("file").isNotNull()).select("id", "file", name.alias("name"), kind_rank().alias("kr"), score.alias("rep"), first.alias("first"))
    pairs = asked.join(reps, (F.col("of") == F.col("file")) & (F.col("asked") != F.col("id")))
    w = Window.partitionBy("asked").orderBy(F.col("rep").desc(), "kr", "name", "id")
    best = pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND rep > 0")
    rank = F.when(F.col("first"), 1).otherwise(F.greatest(F.lit(1), 30 - F.floor(F.col("rep") * 4))).cast("int")
    ranks = best.groupBy("id").agg(F.min(rank).alias("rank")).select("id", F.lit("path").alias("source"), "rank")
    return ranks, best.select("id", F.round(F.col("rep") + OWNER, 6).alias("score"), F.lit("representative owner for matching file").alias("reason"), F.concat_ws(">", "asked", "id").alias("path"))
