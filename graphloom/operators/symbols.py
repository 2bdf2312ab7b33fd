"""Symbol lookup and one-hop relations: candidate tiers, rank expressions, first-per-key windows, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import needles

FINDABLE = ("Function", "Class", "Interface", "TypeAlias", "Symbol", "Test", "Export")


def flag(condition: Column, points: float) -> Column:
    """points where the condition holds, else 0."""
    return F.when(condition, F.lit(points)).otherwise(F.lit(0 * points))


def symbol_rank(needle: str) -> Column:
    """How well a node's name matches, 0 best."""
    n = needle.lower()
    name, qualified = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("qualified_name", F.lit("")))
    backed = F.coalesce(F.col("origin") == "compiler", F.lit(False))
    contains = name.contains(n) | qualified.contains(n)
    return (
        F.when((qualified == n) | (F.lower("id") == n), 0)
        .when((name == n) & backed, 1)
        .when(name == n, 2)
        .when(qualified.endswith("." + n), 3)
        .when((F.col("kind") == "Function") & contains & backed, 4)
        .when((F.col("kind") == "Function") & contains, 5)
        .otherwise(6)
    )


def tie_rank() -> Column:
    """Breaks ties of symbol_rank: source before test, compiler-backed, exported, functions and classes first."""
    return F.lit(100) - flag(F.coalesce(F.col("file_kind") == "source", F.lit(False)), 20) + flag(F.coalesce(F.col("file_kind") == "test", F.lit(False)), 20) - flag(F.coalesce(F.col("origin") == "compiler", F.lit(False)), 15) - flag(F.coalesce("exported", F.lit(False)), 10) - flag(F.col("kind").isin("Function", "Class"), 4) - flag(F.col("kind") == "Symbol", 2) + flag(F.col("kind") == "Export", 4)


def find_symbols(nodes: DataFrame, needle: str, limit: int) -> DataFrame:
    """The best matches of the first tier that has any: exact id, exact qualified name, any needle contained.

    All matches of the tier are ranked (none is cut before), then one stays per (file, name, qualified name).
    """
    n = needle.lower()
    found = nodes.filter(F.col("kind").isin(*FINDABLE))
    qualified = F.lower(F.coalesce("qualified_name", F.lit("")))
    words = needles(F.lit(needle))
    any_word = F.exists(words, lambda w: F.lower(F.coalesce("name", F.lit(""))).contains(w) | qualified.contains(w))
    tier = F.when(F.lower("id") == n, 0).when(qualified == n, 1).when(any_word, 2)
    rows = found.withColumn("tier", tier).filter("tier is not null")
    best = rows.agg(F.min("tier").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best")).withColumn("rank", symbol_rank(needle)).withColumn("tie", tie_rank())
    order = [F.col("rank"), F.col("tie"), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), F.col("id")]
    key = Window.partitionBy("file", "name", F.coalesce("qualified_name", "name")).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(key)).filter("n = 1").orderBy(*order).limit(limit)


def at_ends(edges: DataFrame, seeds: DataFrame | list[str], *ends: str) -> DataFrame:
    """Edges with a seed at one of the ends. A short list of ids becomes a filter, which reaches the edges' own tables."""
    if isinstance(seeds, list):
        keep = F.lit(False)
        for end in ends:
            keep = keep | F.col(end).isin(seeds)
        return edges.filter(keep)
    ids = seeds.select(F.col("id").alias("_seed")).distinct()
    parts = [edges.join(ids, F.col(end) == F.col("_seed"), "left_semi") for end in ends]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def related(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | list[str], kind: str, incoming: bool) -> DataFrame:
    """Edges of a kind at the seeds with the node at the other end. Seeds are a few ids, or a table of any size."""
    near, far = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    hits = at_ends(edges.filter(F.col("kind") == kind), seeds, near).withColumnRenamed("kind", "edge_kind").drop("repo", "origin")
    return hits.withColumn("seed", F.col(near)).join(nodes, hits[far] == nodes["id"])


def by_folder(points: dict[str, int]) -> Column:
    """Points for folders in a node's path."""
    out = F.lit(0)
    for folder, n in points.items():
        out = out + flag(F.coalesce(F.col("file").contains(folder), F.lit(False)), n)
    return out


def reference_score(symbol: str) -> Column:
    """How much a reference tells of a symbol's use, higher first."""
    query = symbol.lower()
    path, name = F.lower(F.coalesce("file", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    has = lambda e: F.coalesce(F.array_contains("evidence", e), F.lit(False))
    rules = [
        (path.contains(query) | name.contains(query), 0.6), (has("compiler"), 0.6), (has("module-resolution"), 0.5), (has("mutation-to-database"), 1.1),
        (F.coalesce(F.col("confidence") == "high", F.lit(False)), 0.4), (path.rlike("mutation|service|api-core"), 0.9), (F.col("kind").isin("Function", "Class", "Symbol"), 0.35),
        (F.col("kind").isin("Import", "Export"), -0.45), (path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$|/__tests__/"), -0.7), (path.rlike("/node_modules/|/dist/|/generated/"), -0.9),
    ]
    if query in ("prisma", "db") or "database" in query:
        rules += [(path.rlike(r"/routes?/|/api/|/route\.[cm]?[jt]sx?$"), 1.7), (path.rlike("mutation|api-core"), 1.45), (path.contains("/billing/"), -3.5)]
    score = F.lit(0.0)
    for fits, points in rules:
        score = score + flag(fits, points)
    return F.round(score, 6)


def call_rank(incoming: bool) -> Column:
    """Order of call relations: lower is better."""
    high = flag(F.coalesce(F.col("confidence") == "high", F.lit(False)), 8)
    compiler = F.array_contains("evidence", "compiler")
    told = lambda e: flag(F.coalesce(F.array_contains("evidence", e), F.lit(False)), 1)
    if incoming:
        high = high + 12 * told("mutation-to-database") + 4 * told("transitive-call") - by_folder({"/api-core/": -16, "/routes/": -12, "/database/": -10, "/scripts/": 28, "/billing/": 24})
        return F.lit(100) - flag(F.col("file_kind") == "source", 18) + flag(F.col("file_kind") == "test", 18) - flag(F.col("kind").isin("Function", "Chunk"), 16) + flag(F.col("kind") == "File", 4) - high - flag(F.array_contains("evidence", "module-resolution"), 10) - flag(compiler, 6)
    return F.lit(100) - flag(F.col("kind").isin("Function", "Class"), 20) - flag(F.col("kind") == "Symbol", 10) - high - flag(compiler, 5) + 25 * told("transitive-call")


def ranked_first(rows: DataFrame, rank: Column, key: list[Column], limit: int) -> DataFrame:
    """One row per key, the best by (rank, file, name, id), and of those the best ``limit``."""
    order = [F.col("rank"), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), F.col("id")]
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", rank).withColumn("n", F.row_number().over(w)).filter("n = 1").orderBy(*order).limit(limit)


def callers(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | list[str], limit: int) -> DataFrame:
    return ranked_first(related(edges, nodes, seeds, "CALLS", True), call_rank(True), [F.col("file"), F.col("name")], limit)


def callees(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | list[str], limit: int) -> DataFrame:
    return ranked_first(related(edges, nodes, seeds, "CALLS", False), call_rank(False), [F.col("id")], limit)


def references(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | list[str], limit: int) -> DataFrame:
    """One reference per file, best first."""
    rank = F.lit(100) - flag(F.col("file_kind") == "source", 18) + flag(F.col("file_kind") == "test", 18) - flag(F.col("kind").isin("Function", "Chunk"), 14) - flag(F.coalesce(F.col("confidence") == "high", F.lit(False)), 8) - flag(F.array_contains("evidence", "compiler"), 6) - flag(F.array_contains("evidence", "module-resolution"), 22) + by_folder({"/api-core/": -10, "/routes/": -6, "/scripts/": 28, "/billing/": 24})
    return ranked_first(related(edges, nodes, seeds, "REFERENCES", True), rank, [F.coalesce("file", "id")], limit)


def relationships(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | list[str], kinds: list[str], limit: int) -> DataFrame:
    """Edges of the kinds in either direction at the seeds, scored (lower is better) and cut after a total order."""
    hits = at_ends(edges.filter(F.col("kind").isin(kinds)), seeds, "from_id", "to_id").withColumnRenamed("kind", "edge_kind").drop("repo", "origin")
    ends = F.explode(F.array(F.struct(F.lit("incoming").alias("direction"), F.col("to_id").alias("seed"), F.col("from_id").alias("_other")), F.struct(F.lit("outgoing").alias("direction"), F.col("from_id").alias("seed"), F.col("to_id").alias("_other"))))
    both = hits.select("*", ends.alias("_e")).select("*", "_e.*").drop("_e")
    both = both.filter(F.col("seed").isin(seeds)) if isinstance(seeds, list) else both.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    rows = both.join(nodes, both["_other"] == nodes["id"]).drop("_other")
    weights = {"CALLS": 22, "REFERENCES": 18, "TESTS": 16}
    score = F.lit(100)
    for kind, w in weights.items():
        score = score - flag(F.col("edge_kind") == kind, w)
    score = score - flag(F.coalesce(F.col("confidence") == "high", F.lit(False)), 8) - flag(F.array_contains("evidence", "compiler"), 7) - flag(F.array_contains("evidence", "module-resolution"), 7) - flag(F.col("kind").isin("Function", "Class", "TypeAlias"), 5) - flag(F.col("direction") == "incoming", 2) + flag(F.col("edge_kind") == "MENTIONS", 20)
    return rows.withColumn("score", score).orderBy("score", "edge_kind", F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), "id", "direction").limit(limit)


def interleaved(sides: list[DataFrame], order: list[str], limit: int) -> DataFrame:
    """Round-robin of several lists: first of each side, second of each, ...; an id keeps its first place."""
    rows = None
    for i, side in enumerate(sides):
        numbered = side.withColumn("turn", F.row_number().over(Window.orderBy(*order))).filter(F.col("turn") <= limit).withColumn("side", F.lit(i))
        rows = numbered if rows is None else rows.unionByName(numbered)
    first = Window.partitionBy("id").orderBy("turn", "side")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").orderBy("turn", "side").limit(limit)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that isn't a node."""
    ids = nodes.select("id")
    return edges.join(ids, edges["from_id"] == ids["id"], "left_anti").unionByName(edges.join(ids, edges["to_id"] == ids["id"], "left_anti")).distinct()


def edges_between(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges from one set of ids into another."""
    return edges.join(starts.select("id"), F.col("from_id") == F.col("id"), "left_semi").join(ends.select("id"), F.col("to_id") == F.col("id"), "left_semi")
