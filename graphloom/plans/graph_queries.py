"""Queries on the graph: lookup, one-hop relations, checks, traversal, graph building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import changes, symbols, traversal
from graphloom.plans.registry import query
from graphloom.sources.graph_views import Tables, edges, nodes, out_degrees, ring

CUSTOMERS = "cust AS (SELECT c_custkey, c_name, c_nationkey, n_name, n_regionkey, 'n' || c_nationkey || '/c' || c_custkey || '.ts' AS file, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'source' END AS file_kind FROM customer JOIN nation ON c_nationkey = n_nationkey)"
FUNCTIONS = "functions AS (SELECT 'function:' || o_orderkey AS id, 'Function' AS kind, 'r' || n_regionkey AS repo, file, 'handle' || o_orderkey % 977 AS name, file_kind, o_orderstatus || '.handle' || o_orderkey % 977 AS qualified_name, o_orderkey % 3 = 0 AS exported, CASE WHEN o_orderkey % 2 = 0 THEN 'compiler' ELSE 'syntax' END AS origin FROM orders JOIN cust ON o_custkey = c_custkey)"
CLASSES = "classes AS (SELECT 'class:' || s_suppkey AS id, 'Class' AS kind, 'r' || n_regionkey AS repo, 'n' || s_nationkey || '/s' || s_suppkey || '.ts' AS file, s_name AS name, 'source' AS file_kind, n_name || '.' || s_name AS qualified_name, TRUE AS exported, 'compiler' AS origin FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
TYPES = "types AS (SELECT 'type:' || p_partkey AS id, 'TypeAlias' AS kind, NULL AS repo, 'types/' || p_brand || '.ts' AS file, p_name AS name, 'source' AS file_kind, p_type || '.' || p_name AS qualified_name, p_size > 25 AS exported, 'syntax' AS origin FROM part)"
SYMBOLS = f"{CUSTOMERS}, {FUNCTIONS}, {CLASSES}, {TYPES}, symbols AS (SELECT * FROM functions UNION ALL SELECT * FROM classes UNION ALL SELECT * FROM types)"


def lines_sql(name: str, key: str, target: str) -> str:
    return f"""{name} AS (
  SELECT 'function:' || l_orderkey AS from_id, '{target}:' || {key} AS to_id, max(o_custkey) AS owner,
    max(CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'fallback' END) AS confidence,
    bool_or(l_returnflag = 'N') AS by_compiler, bool_or(l_returnflag = 'R') AS by_module, bool_or(l_returnflag = 'A') AS by_syntax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, {key})"""


CALLS = lines_sql("calls", "l_suppkey", "class")
REFERENCES = lines_sql("refs", "l_partkey", "type")
RANK = """CASE WHEN lower(qualified_name) = '{n}' OR lower(id) = '{n}' THEN 0 WHEN lower(name) = '{n}' AND origin = 'compiler' THEN 1 WHEN lower(name) = '{n}' THEN 2
  WHEN ends_with(lower(qualified_name), '.{n}') THEN 3 WHEN kind = 'Function' AND (contains(lower(name), '{n}') OR contains(lower(qualified_name), '{n}')) AND origin = 'compiler' THEN 4
  WHEN kind = 'Function' AND (contains(lower(name), '{n}') OR contains(lower(qualified_name), '{n}')) THEN 5 ELSE 6 END"""
TIE = "100 - CASE WHEN file_kind = 'source' THEN 20 ELSE -20 END - CASE WHEN origin = 'compiler' THEN 15 ELSE 0 END - CASE WHEN exported THEN 10 ELSE 0 END - CASE WHEN kind IN ('Function', 'Class') THEN 4 ELSE 0 END"


def find_sql(needle: str, tier: int, match: str, limit: int) -> str:
    n = needle.lower()
    return f"""WITH {SYMBOLS}, r AS (SELECT *, {tier} AS tier, {RANK.format(n=n)} AS rank, {TIE} AS tie FROM symbols WHERE {match}),
d AS (SELECT *, row_number() OVER (PARTITION BY file, name, qualified_name ORDER BY rank, tie, file, name, id) AS n FROM r)
SELECT id, kind, tier, rank, tie FROM d WHERE n = 1 ORDER BY rank, tie, file, name, id LIMIT {limit}"""


def _found(t: Tables, needle: str, limit: int) -> DataFrame:
    return symbols.find_symbols(nodes(t, "Function", "Class", "TypeAlias"), needle, limit).select("id", "kind", "tier", "rank", "tie")


@query(find_sql("O.handle12", 1, "lower(qualified_name) = 'o.handle12'", 20))
def find_symbol_exact(t: Tables) -> DataFrame:
    return _found(t, "O.handle12", 20)


@query(find_sql("handle12", 2, "contains(lower(name), 'handle12') OR contains(lower(qualified_name), 'handle12')", 50))
def find_symbol_substring(t: Tables) -> DataFrame:
    return _found(t, "handle12", 50)


@query(find_sql("red ring", 2, "contains(lower(name), 'red') OR contains(lower(name), 'ring') OR contains(lower(qualified_name), 'red') OR contains(lower(qualified_name), 'ring')", 30))
def symbol_rank_order(t: Tables) -> DataFrame:
    return _found(t, "red ring", 30)


SEED = "class:7"


@query(f"""WITH {CUSTOMERS}, {FUNCTIONS}, {CALLS},
r AS (SELECT f.*, 100 - CASE WHEN file_kind = 'source' THEN 18 ELSE -18 END - 16 - CASE WHEN confidence = 'high' THEN 8 ELSE 0 END - CASE WHEN by_module THEN 10 ELSE 0 END - CASE WHEN by_compiler THEN 6 ELSE 0 END AS rank
  FROM calls JOIN functions f ON from_id = f.id WHERE to_id = '{SEED}'),
d AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY rank, file, name, id) AS n FROM r)
SELECT id, file, name, rank FROM d WHERE n = 1 ORDER BY rank, file, name, id LIMIT 50""")
def callers(t: Tables) -> DataFrame:
    return symbols.callers(edges(t, "CALLS"), nodes(t, "Function"), [SEED], 50).select("id", "file", "name", "rank")


@query(f"""WITH {CLASSES}, {CALLS},
r AS (SELECT c.id, c.file, c.name, 80 - CASE WHEN confidence = 'high' THEN 8 ELSE 0 END - CASE WHEN by_compiler THEN 5 ELSE 0 END AS rank FROM calls JOIN classes c ON to_id = c.id WHERE from_id IN ('function:1', 'function:2', 'function:3', 'function:5')),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, file, name, id) AS n FROM r)
SELECT id, file, name, rank FROM d WHERE n = 1 ORDER BY rank, file, name, id LIMIT 10""")
def callees(t: Tables) -> DataFrame:
    seeds = [f"function:{i}" for i in (1, 2, 3, 5)]
    return symbols.callees(edges(t, "CALLS"), nodes(t, "Class"), seeds, 10).select("id", "file", "name", "rank")


@query(f"""WITH {CUSTOMERS}, {FUNCTIONS}, {REFERENCES},
r AS (SELECT f.*, 100 - CASE WHEN file_kind = 'source' THEN 18 ELSE -18 END - 14 - CASE WHEN confidence = 'high' THEN 8 ELSE 0 END - CASE WHEN by_compiler THEN 6 ELSE 0 END - CASE WHEN by_module THEN 22 ELSE 0 END AS rank
  FROM refs JOIN functions f ON from_id = f.id WHERE to_id = 'type:11'),
d AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank, file, name, id) AS n FROM r)
SELECT id, file, name, rank FROM d WHERE n = 1 ORDER BY rank, file, name, id LIMIT 40""")
def references(t: Tables) -> DataFrame:
    return symbols.references(edges(t, "REFERENCES"), nodes(t, "Function"), ["type:11"], 40).select("id", "file", "name", "rank")


@query(f"""WITH {SYMBOLS}, {CALLS}, {REFERENCES},
e AS (SELECT 'CALLS' AS edge_kind, from_id, to_id, confidence, by_compiler, by_module FROM calls UNION ALL SELECT 'REFERENCES', from_id, to_id, confidence, by_compiler, by_module FROM refs),
r AS (SELECT edge_kind, to_id AS other, 'outgoing' AS direction, confidence, by_compiler, by_module FROM e WHERE from_id IN ('function:3', 'class:7') UNION ALL
  SELECT edge_kind, from_id, 'incoming', confidence, by_compiler, by_module FROM e WHERE to_id IN ('function:3', 'class:7'))
SELECT edge_kind, direction, id, 100 - CASE edge_kind WHEN 'CALLS' THEN 22 ELSE 18 END - CASE WHEN confidence = 'high' THEN 8 ELSE 0 END - CASE WHEN by_compiler THEN 7 ELSE 0 END - CASE WHEN by_module THEN 7 ELSE 0 END - 5 - CASE WHEN direction = 'incoming' THEN 2 ELSE 0 END AS score
FROM r JOIN symbols ON other = id ORDER BY score, edge_kind, file, name, id, direction LIMIT 60""")
def relationships_either(t: Tables) -> DataFrame:
    seeds = ["function:3", "class:7"]
    rows = symbols.relationships(edges(t, "CALLS", "REFERENCES"), nodes(t, "Function", "Class", "TypeAlias"), seeds, ["CALLS", "REFERENCES"], 60)
    return rows.select("edge_kind", "direction", "id", "score")


@query(f"""WITH {CALLS}, {REFERENCES},
a AS (SELECT to_id AS id, row_number() OVER (ORDER BY to_id) AS turn, 0 AS side FROM calls WHERE from_id = 'function:3'),
b AS (SELECT to_id AS id, row_number() OVER (ORDER BY to_id) AS turn, 1 AS side FROM refs WHERE from_id = 'function:3'),
u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, side) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT id, turn, side FROM u WHERE n = 1 ORDER BY turn, side LIMIT 7""")
def adjacent_interleave(t: Tables) -> DataFrame:
    sides = [edges(t, k).filter("from_id = 'function:3'").select(F.col("to_id").alias("id")) for k in ("CALLS", "REFERENCES")]
    return symbols.interleaved(sides, ["id"], 7).select("id", "turn", "side")


@query("""SELECT 'chunk:' || doc_id AS id, substr(text, 1, 200) AS excerpt FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20""")
def context_chunks(t: Tables) -> DataFrame:
    found = symbols.related(edges(t, "HAS_CHUNK"), nodes(t, "Chunk"), ["source:src3"], "HAS_CHUNK", False)
    return found.orderBy(F.substring_index("id", ":", -1).cast("long")).limit(20).select("id", F.substring("content", 1, 200).alias("excerpt"))


@query("""SELECT 'HAS_CHUNK' AS kind, 'source:' || source AS from_id, count(*) AS n FROM documents GROUP BY source""")
def dangling_edges(t: Tables) -> DataFrame:
    bad = symbols.dangling(edges(t, "HAS_CHUNK", "DEFINES"), nodes(t, "Chunk", "File", "Function"))
    return bad.groupBy("kind", "from_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CUSTOMERS}, {FUNCTIONS}, {CLASSES}, {CALLS}
SELECT count(*) AS n, count(*) > 0 AS holds FROM calls WHERE from_id IN (SELECT id FROM functions WHERE file_kind = 'test') AND to_id IN (SELECT id FROM classes WHERE repo = 'r1')""")
def edge_exists(t: Tables) -> DataFrame:
    found = symbols.edges_between(edges(t, "CALLS"), nodes(t, "Function").filter("file_kind = 'test'"), nodes(t, "Class").filter("repo = 'r1'"))
    return found.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("holds"))


@query(f"WITH {CALLS} SELECT count(*) = 0 AS holds FROM calls WHERE from_id IN (SELECT 'function:' || o_orderkey FROM orders) AND to_id LIKE 'type:%'")
def no_edge(t: Tables) -> DataFrame:
    found = symbols.edges_between(edges(t, "CALLS"), nodes(t, "Function"), nodes(t, "TypeAlias"))
    return found.agg((F.count(F.lit(1)) == 0).alias("holds"))


@query(f"WITH {CUSTOMERS} SELECT 'file:' || c_custkey AS id, file FROM cust WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_files(t: Tables) -> DataFrame:
    wanted = t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("file:"), F.col("o_custkey").cast("string")).alias("fid"))
    return nodes(t, "File").join(wanted, F.col("id") == F.col("fid"), "left_semi").select("id", "file")


def _ring_sql(name: str = "g", weights: bool = False) -> str:
    kinds = "['CALLS', 'REFERENCES', 'IMPORTS', 'DEFINES', 'MENTIONS'][(p_partkey % 5 + 1)::INT]"
    weight = f", CASE p_partkey % 5 WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 10 ELSE 1 END AS weight"
    return f"{name} AS (SELECT {kinds} AS kind, p_partkey AS from_id, (p_partkey * 17 + 11) % (SELECT count(*) FROM part) AS to_id{weight if weights else ''} FROM part)"


def weighted(t: Tables) -> DataFrame:
    weight = F.when(F.col("kind") == "CALLS", 40).when(F.col("kind").isin("REFERENCES", "IMPORTS"), 30).when(F.col("kind") == "DEFINES", 10).otherwise(1)
    return ring(t).withColumn("weight", weight)


def double_ring(t: Tables) -> DataFrame:
    """The ring with a second edge from each part, to the next one."""
    r = weighted(t)
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    step = r.join(F.broadcast(n)).select(F.lit("CALLS").alias("kind"), "from_id", ((F.col("from_id") + 1) % F.col("n")).alias("to_id"), F.lit(40).alias("weight"))
    return r.unionByName(step)


DOUBLE = _ring_sql("g0", True) + ", g AS (SELECT * FROM g0 UNION ALL SELECT 'CALLS', p_partkey, (p_partkey + 1) % (SELECT count(*) FROM part), 40 FROM part)"


@query(f"""WITH RECURSIVE {DOUBLE}, both_ways AS (SELECT from_id, to_id FROM g UNION SELECT to_id, from_id FROM g),
r(id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT to_id, depth + 1 FROM r JOIN both_ways ON id = from_id WHERE depth < 4)
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def expand_context_depth(t: Tables) -> DataFrame:
    return traversal.expand(double_ring(t), t.spark.createDataFrame([(5,)], "id long"), 4)


@query(f"""WITH RECURSIVE {_ring_sql()}, r(id, hops) AS (SELECT 3::BIGINT, 0 UNION ALL SELECT to_id, hops + 1 FROM r JOIN g ON id = from_id WHERE hops < 12)
SELECT id, min(hops) AS hops FROM r GROUP BY id""")
def reachability_recursive(t: Tables) -> DataFrame:
    ring(t).createOrReplaceTempView("ring_edges")
    return t.spark.sql("""WITH RECURSIVE r(id, hops) AS (SELECT 3L, 0 UNION ALL SELECT to_id, hops + 1 FROM r JOIN ring_edges ON id = from_id WHERE hops < 12)
        SELECT id, min(hops) AS hops FROM r GROUP BY id""")


@query(f"""WITH {DOUBLE}, c AS (SELECT from_id, to_id, bool_or(weight = 40) AS high FROM g WHERE kind IN ('CALLS', 'REFERENCES') GROUP BY from_id, to_id),
p AS (SELECT a.from_id, a.to_id AS via_id, b.to_id, a.high AND b.high AS high FROM c a JOIN c b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id AND NOT EXISTS (SELECT 1 FROM c d WHERE d.from_id = a.from_id AND d.to_id = b.to_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY via_id, high) AS n FROM p)
SELECT from_id, via_id, to_id, CASE WHEN high THEN 'high' ELSE 'medium' END AS confidence FROM m WHERE n = 1""")
def transitive_calls(t: Tables) -> DataFrame:
    calls = double_ring(t).filter("kind IN ('CALLS', 'REFERENCES')").withColumn("confidence", F.when(F.col("weight") == 40, "high").otherwise("medium"))
    return traversal.two_hop_calls(calls)


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"))


def _goals(t: Tables) -> DataFrame:
    """(start, goal): every part with every other part within four edges."""
    return traversal.paths(double_ring(t), _parts(t), 4).select("start", F.col("id").alias("goal")).distinct()


PATHS = f"""WITH RECURSIVE {DOUBLE}, starts AS (SELECT p_partkey AS s FROM part),
r(start, id, hops, path, score) AS (SELECT s, s, 0, [s], 0::BIGINT FROM starts UNION ALL
  SELECT start, to_id, hops + 1, list_append(path, to_id), score + weight - (hops + 1) FROM r JOIN g ON id = from_id WHERE hops < 4 AND NOT list_contains(path, to_id))"""


@query(PATHS + " SELECT start, count(DISTINCT id) AS reached, count(*) AS paths FROM r WHERE hops > 0 GROUP BY start")
def path_exists_bounded(t: Tables) -> DataFrame:
    """Simple paths of up to four edges from every part."""
    return traversal.paths(double_ring(t), _parts(t), 4).groupBy("start").agg(F.countDistinct("id").alias("reached"), F.count(F.lit(1)).alias("paths"))


@query(PATHS + """, w AS (SELECT start, id AS goal, hops, score, array_to_string(path, '>') AS path FROM r WHERE hops > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY score DESC, hops, path) AS n FROM w) SELECT start, goal, hops, score, path FROM b WHERE n = 1""")
def best_path_score(t: Tables) -> DataFrame:
    """From every part the best path to each part within four edges."""
    return traversal.best_paths(double_ring(t), _goals(t), 4)


@query()
def best_first_path(t: Tables) -> DataFrame:
    """From every part to every other one within four edges."""
    return traversal.best_first(double_ring(t), _parts(t).withColumnRenamed("id", "start"), 4)


@query(f"""WITH RECURSIVE {DOUBLE}, r(start, id, hops, called) AS (SELECT p_partkey, p_partkey, 0, FALSE FROM part UNION
  SELECT start, to_id, hops + 1, called OR kind = 'CALLS' FROM r JOIN g ON id = from_id WHERE hops < 3 AND to_id <> start)
SELECT start, id, min(hops) AS hops FROM r WHERE called GROUP BY start, id""")
def indirect_coverage_3hop(t: Tables) -> DataFrame:
    """From every part."""
    return traversal.indirect_coverage(double_ring(t), _parts(t))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS f, (p_partkey * 3 + 1) % n AS target FROM part, n WHERE p_partkey % 4 <> 0),
r(origin, f, seen) AS (SELECT p_partkey, p_partkey, [p_partkey] FROM part UNION ALL SELECT origin, target, list_append(seen, target) FROM r JOIN e USING (f) WHERE NOT list_contains(seen, target))
SELECT origin AS module, min(f) FILTER (f % 4 = 0) AS declares, max(len(seen))::BIGINT AS depth FROM r GROUP BY origin""")
def star_reexport_recursive(t: Tables) -> DataFrame:
    """Follows star re-exports to the modules that declare a name, never in a circle."""
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    exports = t.part.join(F.broadcast(n)).filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("f"), ((F.col("p_partkey") * 3 + 1) % F.col("n")).alias("target"))
    found = traversal.chains(t.part.select(F.col("p_partkey").alias("f")), exports)
    return found.select(F.col("origin").alias("module"), F.when(F.col("last") % 4 == 0, F.col("last")).alias("declares"), "depth")


@query(f"""WITH {REFERENCES}, e AS (SELECT from_id, to_id, owner FROM refs WHERE by_syntax)
SELECT 'CALLS' AS kind, a AS from_id, to_id, count(*) AS n FROM (SELECT unnest([from_id, 'file:' || owner]) AS a, to_id FROM e) WHERE a <> to_id GROUP BY a, to_id""")
def call_promotion(t: Tables) -> DataFrame:
    """References with call evidence become calls, of the function and of its file."""
    refs = edges(t, "REFERENCES").filter(F.array_contains("evidence", "call-syntax"))
    files = F.concat(F.lit("file:"), F.regexp_extract("owner_file", "/c([0-9]+)", 1))
    rows = refs.select(F.explode(F.array("from_id", files)).alias("from_id"), "to_id").filter("from_id <> to_id")
    return rows.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("CALLS").alias("kind"), "from_id", "to_id", "n")


@query(f"""WITH {CUSTOMERS} SELECT t.file AS test_file, min(s.file) AS source_file FROM cust t JOIN cust s ON t.c_nationkey = s.c_nationkey AND s.file_kind = 'source' AND s.c_custkey > t.c_custkey
WHERE t.file_kind = 'test' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = t.c_custkey AND o_orderstatus = 'P') GROUP BY t.file""")
def colocated_fallback_anti(t: Tables) -> DataFrame:
    """Tests without a direct link get a source file of their folder."""
    files = nodes(t, "File").select("id", "file", "file_kind", F.substring_index("file", "/", 1).alias("folder"), F.regexp_extract("file", "/c([0-9]+)", 1).cast("long").alias("k"))
    linked = t.orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("file:"), F.col("o_custkey").cast("string")).alias("lid"))
    after = Window.partitionBy("folder").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = files.withColumn("source_file", F.min(F.when(F.col("file_kind") == "source", F.col("file"))).over(after))
    tests = first.filter("file_kind = 'test' AND source_file IS NOT NULL")
    return tests.join(linked, F.col("id") == F.col("lid"), "left_anti").select(F.col("file").alias("test_file"), "source_file")


@query(f"""WITH {CUSTOMERS}, l AS (SELECT c_nationkey, min(c_custkey) AS layout FROM cust GROUP BY c_nationkey)
SELECT 'file:' || c.c_custkey AS from_id, 'file:' || layout AS to_id FROM cust c JOIN l USING (c_nationkey) WHERE c.c_custkey <> layout""")
def layout_self_join(t: Tables) -> DataFrame:
    """Every file refers to its folder's layout, the first file there."""
    files = nodes(t, "File").select("id", F.substring_index("file", "/", 1).alias("folder"), F.regexp_extract("file", "/c([0-9]+)", 1).cast("long").alias("k"))
    layout = files.groupBy("folder").agg(F.min_by("id", "k").alias("to_id"))
    return files.join(layout, "folder").filter("id <> to_id").select(F.col("id").alias("from_id"), "to_id")


@query(f"""WITH {CALLS}, {REFERENCES}, e AS (SELECT from_id, to_id FROM calls UNION ALL SELECT from_id, to_id FROM refs)
SELECT from_id, count(*) AS n_out, count(DISTINCT to_id) AS n_targets FROM e GROUP BY from_id""")
def out_degree(t: Tables) -> DataFrame:
    """Edges and targets of every from_id."""
    return out_degrees(t)


@query("""WITH e AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
SELECT 'function:' || l_orderkey AS from_id, 'class:' || l_suppkey AS to_id, arg_max(l_linestatus, l_linenumber * 1000 + ascii(l_linestatus)) AS origin, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS evidence
FROM e GROUP BY l_orderkey, l_suppkey""")
def edge_metadata_merge(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.lit("CALLS").alias("kind"), F.concat(F.lit("function:"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("class:"), F.col("l_suppkey").cast("string")).alias("to_id"), F.col("l_linestatus").alias("origin"), F.lit("high").alias("confidence"), F.array("l_returnflag").alias("evidence"), (F.col("l_linenumber") * 1000 + F.ascii("l_linestatus")).alias("seq"))
    return changes.merged_edges(rows).select("from_id", "to_id", "origin", F.array_join("evidence", ",").alias("evidence"))
