"""The query API: every method takes plain arguments and returns a DataFrame over one opened graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import query_words, truncate_utf8
from graphloom.functions.vectors import cosine, hash_embedding
from graphloom.operators import path_ranking, retrieval, symbols, traversal
from graphloom.operators.search import search_lines
from graphloom.sources.durable import cut

EXCERPT_BYTES, MOST_ROWS, MOST_DEPTH = 16_000, 50, 8
EDGE_KINDS = ("CONTAINS", "DEFINES", "CALLS", "REFERENCES", "IMPORTS", "EXPORTS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "HAS_CHUNK", "TESTS", "MENTIONS")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Engine:
    """Bounded questions over nodes and edges (see ``graphloom.sources.graph_views`` for their columns).

    Limits are held to 50 rows and depths to 8. A result is ranked in full before it is cut, with the id last, so the
    same graph gives the same rows. ``vectors`` (id, embedding) are those of the chunks; hashed ones by default.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None):
        self.nodes, self.edges = nodes, edges
        self.spark: SparkSession = nodes.sparkSession
        self._vectors = vectors

    def _limit(self, limit: int) -> int:
        return max(1, min(MOST_ROWS, limit))

    def _seeds(self, symbol: str) -> DataFrame:
        """Ids of what a name stands for; a File has no symbol of its own and is found by its id."""
        found = symbols.find_symbols(self.nodes, symbol, MOST_ROWS).select("id")
        return found.unionByName(self.nodes.filter(F.col("id") == symbol).select("id")).distinct()

    def find_symbol(self, name: str, limit: int = 10) -> DataFrame:
        return symbols.find_symbols(self.nodes, name, self._limit(limit)).select("id", "kind", "file", "name", "qualified_name", "tier", "rank")

    def callers(self, symbol: str, limit: int = 10) -> DataFrame:
        return symbols.callers(self.edges, self.nodes, self._seeds(symbol), self._limit(limit))

    def callees(self, symbol: str, limit: int = 10) -> DataFrame:
        """What a symbol calls, and what its file calls outside of any symbol."""
        seeds = self._seeds(symbol)
        files = self.nodes.join(seeds, "id", "left_semi").filter("file is not null").select("file").distinct()
        own = self.nodes.filter("kind = 'File'").join(files, "file", "left_semi").select("id")
        return symbols.callees(self.edges, self.nodes, seeds.unionByName(own), self._limit(limit))

    def references(self, symbol: str, limit: int = 10) -> DataFrame:
        """Where a symbol is used, the most telling first, then its definitions."""
        n = self._limit(limit)
        used = symbols.references(self.edges, self.nodes, self._seeds(symbol), n).withColumn("score", symbols.reference_score(symbol))
        named = (F.col("name") == symbol) | F.coalesce(F.col("qualified_name") == symbol, F.lit(False))
        defined = symbols.find_symbols(self.nodes, symbol, min(n, 10)).filter(named & F.col("kind").isin("Function", "Class", "Interface", "TypeAlias", "Symbol", "Chunk")).limit(5)
        columns = ["id", "kind", "file", "name"]
        both = used.select(*columns, "score", F.lit(False).alias("definition")).unionByName(defined.join(used.select("id"), "id", "left_anti").select(*columns, F.lit(None).cast("double").alias("score"), F.lit(True).alias("definition")))
        return both.orderBy("definition", F.col("score").desc(), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), "id").limit(n)

    def relationships(self, symbol: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
        return symbols.relationships(self.edges, self.nodes, self._seeds(symbol), list(kinds or EDGE_KINDS), self._limit(limit))

    def expand_context(self, node_id: str, depth: int = 2, limit: int = 50) -> DataFrame:
        """Nodes within ``depth`` hops in either direction, nearest first."""
        seeds = self.spark.createDataFrame([(node_id,)], "id string")
        found = traversal.expand(self.edges, seeds, max(1, min(4, depth)))
        return found.join(self.nodes, "id").orderBy("depth", F.coalesce("file", F.lit("")), "id").limit(self._limit(limit))

    def get_context(self, node_id: str, limit: int = 5) -> DataFrame:
        """Source of the node's chunks, then of chunks that mention it, each at most 16 000 bytes."""
        seeds = self.spark.createDataFrame([(node_id,)], "id string")
        own = symbols.related(self.edges, self.nodes, seeds, "HAS_CHUNK", False).withColumn("place", F.lit(0))
        told = symbols.related(self.edges, self.nodes, seeds, "MENTIONS", True).filter("kind = 'Chunk'").withColumn("place", F.lit(1))
        rows = own.unionByName(told).groupBy("id").agg(F.min("place").alias("place"), F.first("file").alias("file"), F.first("content").alias("content"))
        return rows.orderBy("place", "id").limit(self._limit(limit)).select("id", "file", truncate_utf8(F.col("content"), EXCERPT_BYTES).alias("excerpt"))

    def trace_path(self, start: str, goal: str, depth: int = 4, kinds: tuple[str, ...] | None = None, direction: str = "either", require_evidence: bool | dict[str, list[str]] | None = None, through_packages: bool = False) -> DataFrame:
        """The best-first path between two nodes: start, goal, hops, score, path. None from a node to itself.

        Packages aren't passed through unless asked for, or dependencies are among the kinds.
        """
        steps = traversal.steps_of(self.edges, direction, list(kinds) if kinds else None, require_evidence)
        pairs = self.spark.createDataFrame([(start, goal)], "start string, goal string")
        open_ = through_packages or "DEPENDS_ON" in (kinds or ())
        closed = None if open_ else self.nodes.filter("kind = 'Package'").select("id")
        return traversal.best_first(steps, pairs, max(1, min(MOST_DEPTH, depth)), closed=closed)

    def trace_through(self, groups: list[list[str]], depth: int = 4, kinds: tuple[str, ...] | None = None, direction: str = "outgoing", require_evidence: bool | dict[str, list[str]] | None = None) -> DataFrame:
        """The way through one node of each group, in order: hops, score, path."""
        rows = [(0, place, id_) for place, ids in enumerate(groups) for id_ in ids]
        asked = self.spark.createDataFrame(rows, "seq int, place int, id string").join(self.nodes.select("id"), "id", "left_semi")
        steps = traversal.steps_of(self.edges, direction, list(kinds) if kinds else None, require_evidence)
        closed = None if "DEPENDS_ON" in (kinds or ()) else self.nodes.filter("kind = 'Package'").select("id")
        return traversal.ordered_paths(steps, asked, max(1, min(MOST_DEPTH, depth)), closed=closed).drop("seq")

    def search_text(self, pattern: str, limit: int = 50) -> DataFrame:
        return search_lines(self.nodes.filter("content is not null"), pattern, ["file", "id"], "content", self._limit(limit))

    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = hash_embedding(self.nodes.filter("kind = 'Chunk'").select("id", "content"), "id", "content")
        return self._vectors

    def semantic_search(self, query: str, limit: int = 10, repo: str | None = None, package_name: str | None = None, file_kind: str | None = None, symbol_kind: str | None = None) -> DataFrame:
        """Vector, lexical, symbol, graph, path and test candidates fused by reciprocal rank, boosted, demoted, capped and
        explained. The filters keep nodes of a repo, package, kind of file or of symbol before anything is ranked.
        """
        model = retrieval.query_model(query)
        keep = retrieval.passes({"repo": repo, "package_name": package_name, "file_kind": file_kind and file_kind.lower(), "symbol_kind": symbol_kind})
        nodes = self.nodes.filter(keep)
        asked = self.spark.createDataFrame([("query", query)], "id string, content string")
        vector = hash_embedding(asked, "id", "content").select(F.col("embedding").alias("asked"))
        near = self.vectors().join(F.broadcast(vector)).select("id", cosine(F.col("embedding"), F.col("asked")).alias("s")).join(nodes.select("id"), "id", "left_semi")
        # one row of the query, and at most a few hundred of each source from here on
        semantic = cut(retrieval.top(near, [F.round("s", 9).desc()], max(5 * self._limit(limit), 50), "semantic"))
        lex = cut(retrieval.lexical(nodes, model).select("id", "kind", "file", "file_kind", "name", "lexical", "matched"))
        kept = nodes.select("id")
        names = cut(retrieval.named(self.nodes, model))
        by_name = retrieval.first_places(names.join(kept, "id", "left_semi"), ["token", "place"], "symbol")
        met = cut(retrieval.neighbours(self.edges, self.nodes, names.select("id", "token"), ["token"], 10).join(kept, "id", "left_semi"))
        told = [met.withColumn("direct", F.lit(True)).select("id", "edge_kind", "evidence", "direct")]
        parts = [semantic, retrieval.top_lexical(lex), by_name, retrieval.first_places(met, ["token", "spec", "place"], "graph")]
        files = nodes.filter("kind = 'File'").select(F.col("id").alias("fid"), F.col("file").alias("of"))
        close = nodes.join(semantic.filter("rank <= 12").select("id"), "id").select("id", "file")
        beside = close.select("id").unionByName(close.join(files, F.col("file") == F.col("of")).select(F.col("fid").alias("id")))
        around = cut(retrieval.adjacent(self.edges, beside, 120).filter(retrieval.neighbour_fits(model)).join(nodes.select("id"), "id", "left_semi"))
        parts.append(retrieval.first_places(around, ["turn"], "graph"))
        told.append(around.select("id", "edge_kind", "evidence", F.lit(True).alias("direct")))
        if retrieval.expands_flow(model):
            known = _united(parts).select("id").distinct()
            start = nodes.join(known, "id").orderBy(retrieval.flow_seed_rank(model), F.coalesce("file", F.lit("")), F.coalesce("name", F.lit("")), "id").limit(48)
            flow = cut(retrieval.adjacent(self.edges, start, 48 * 80).filter(retrieval.neighbour_fits(model)).join(nodes.select("id"), "id", "left_semi"))
            parts.append(retrieval.first_places(flow, ["turn"], "graph"))
            told.append(flow.select("id", "edge_kind", "evidence", F.lit(True).alias("direct")))
        ways = None
        if path_ranking.applies(model):
            known = cut(_united(parts))
            found = cut(path_ranking.paths(nodes, self.edges, path_ranking.seeds(nodes, known, lex, model), model))
            ranks, on, ways = path_ranking.path_candidates(found, nodes, model)
            parts.append(ranks)
            told.append(on)
            heads, why = path_ranking.owners(nodes, _united([known, ranks]), model)
            parts.append(heads)
            rows = ways.select("id", F.explode("paths").alias("p")).select("id", "p.score", "p.reason", "p.path")
            ways = path_ranking.explained(rows.unionByName(why))
        if model.intent == "test":
            parts += retrieval.test_candidates(lex, nodes)
        rows = retrieval.hybrid(nodes, cut(_united(parts)), model, self._limit(limit), _united(told), lex, ways)
        paths = F.col("paths") if ways is not None else F.lit(None)
        return rows.select("id", "kind", "file", "name", "score", retrieval.normalized(F.col("score")).alias("normal"), F.lit(model.intent).alias("intent"), "sources", "boost", "demotion", "reasons", "demoted", paths.alias("paths"))

    def query_terms(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query,)], "q string").select(query_words(F.col("q")).alias("words"))

    def health(self) -> DataFrame:
        """One row a check: what is counted and how many are wrong."""
        checks = [
            self.nodes.agg(F.lit("nodes with a repeated id").alias("check"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("wrong")),
            symbols.dangling(self.edges.select("kind", "from_id", "to_id"), self.nodes).agg(F.lit("edges without an end").alias("check"), F.count(F.lit(1)).alias("wrong")),
            self.edges.filter(~F.col("kind").isin(*EDGE_KINDS)).agg(F.lit("edges of unknown kind").alias("check"), F.count(F.lit(1)).alias("wrong")),
        ]
        out = checks[0]
        for c in checks[1:]:
            out = out.unionByName(c)
        return out
