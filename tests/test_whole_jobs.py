"""Registered queries over all of their tables, also where their SQL reads only a part."""

import os

import duckdb
import pytest

from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "orders lineitem part documents benchmark".split():
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def rows_of(spark, name):
    df = registry.queries()[name](spark, DATA)
    return sorted(df.columns), sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def without(sql, name, *ranges):
    """Rows of the query's SQL, in the order of its sorted columns, with the given ranges taken out of its text."""
    text = registry.oracle_sql()[name]
    for r in ranges:
        text = text.replace(r, "")
    result = sql.execute(text)
    names = [d[0] for d in result.description]
    return sorted(names), sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())


def test_out_degree_of_all_functions(spark, sql):
    got = rows_of(spark, "out_degree")
    assert got == without(sql, "out_degree", " WHERE o_orderkey < 400")
    assert len(got[1]) == sql.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]


def test_range_overlap_of_all_files(spark, sql):
    got = rows_of(spark, "range_overlap")
    assert got == without(sql, "range_overlap", " WHERE x.f % 10 = 0")
    assert {f % 10 for f, _, _ in got[1]} == set(range(10))


def test_substring_theta_join_of_all_sources_and_whole_texts(spark, sql, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, f"before {passage} after", "src7"), (2, passage, "src3"), (3, passage[:24] + " and other words", "src3"), (4, None, "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.queries()["substring_theta_join"](spark, str(tmp_path)).select("doc_id", "item_id")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3), (2, 3)]
    want = sql.execute("SELECT d.doc_id, item_id FROM documents d JOIN benchmark i ON contains(d.text, i.text) ORDER BY 1, 2").fetchall()
    assert want and rows_of(spark, "substring_theta_join")[1] == want


def brute_paths(n, depth=4):
    """All simple paths of 1 to depth edges on the double ring of n parts: start -> [(path, score)]."""
    weight = {0: 40, 1: 30, 2: 30, 3: 10, 4: 1}
    out = {i: [((i * 17 + 11) % n, weight[i % 5]), ((i + 1) % n, 40)] for i in range(n)}
    found = {}
    for start in range(n):
        now = [((start,), 0)]
        for hop in range(1, depth + 1):
            now = [((*path, b), score + w - hop) for path, score in now for b, w in out[path[-1]] if b not in path]
            found.setdefault(start, []).extend(now)
    return found


def best_of(found):
    best = {}
    for start, ways in found.items():
        for path, score in ways:
            key = (-score, len(path) - 1, ">".join(map(str, path)))
            best[start, path[-1]] = min(best.get((start, path[-1]), key), key)
    return sorted((a, b, hops, -score, path) for (a, b), (score, hops, path) in best.items())


def ordered(spark, name, *columns):
    return sorted(tuple(r) for r in registry.queries()[name](spark, DATA).select(*columns).collect())


def test_paths_from_all_parts_to_all_goals(spark):
    found = brute_paths(200)
    want = sorted((s, len({p[-1] for p, _ in ways}), len(ways)) for s, ways in found.items())
    assert ordered(spark, "path_exists_bounded", "start", "reached", "paths") == want
    assert ordered(spark, "best_path_score", "start", "goal", "hops", "score", "path") == best_of(found)


def test_indirect_coverage_from_all_parts(spark, sql):
    assert rows_of(spark, "indirect_coverage_3hop") == without(sql, "indirect_coverage_3hop", " WHERE p_partkey % 5 = 0")


def best_first_of(n, depth=4):
    """Best-first searches on the double ring of n parts, one for each start and each part within depth of it."""
    import heapq

    weight = {0: 40, 1: 30, 2: 30, 3: 10, 4: 1}
    out = {i: [((i * 17 + 11) % n, weight[i % 5]), ((i + 1) % n, 40)] for i in range(n)}
    rows = []
    for start, ways in brute_paths(n, depth).items():
        for goal in {path[-1] for path, _ in ways}:
            queue, entered, hits = [(0, 0, (start,))], {start: 0}, []
            while queue:
                score, hops, path = heapq.heappop(queue)
                for b, w in sorted(out[path[-1]], key=lambda e: (-e[1], e[0])) if hops < depth else []:
                    new = (score - w + hops + 1, hops + 1, (*path, b))
                    if b == goal and b not in path:
                        hits.append(new)
                    elif b not in path and hops + 1 < entered.get(b, depth + 1):
                        entered[b] = hops + 1
                        heapq.heappush(queue, new)
            if hits:
                score, hops, path = min(hits)
                rows.append((start, goal, hops, -score, ">".join(map(str, path))))
    return sorted(rows)


def test_best_first_from_all_parts_to_all_goals(spark):
    got = ordered(spark, "best_first_path", "start", "goal", "hops", "score", "path")
    assert got == best_first_of(200)
    assert {s for s, *_ in got} == set(range(200))


@pytest.mark.parametrize("n", [200, 203, 30])
def test_star_reexports_of_any_length(spark, tmp_path, n):
    spark.range(n).select("id").withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    want = []
    for origin in range(n):
        seen = [origin]
        while seen[-1] % 4 and (seen[-1] * 3 + 1) % n not in seen:
            seen.append((seen[-1] * 3 + 1) % n)
        want.append((origin, min((f for f in seen if f % 4 == 0), default=None), len(seen)))
    assert n == 30 or max(depth for *_, depth in want) > 9
    got = registry.queries()["star_reexport_recursive"](spark, str(tmp_path)).select("module", "declares", "depth")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_out_degree_counts_keys_and_not_their_text(spark):
    plan = registry.queries()["out_degree"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(from_id" not in plan


def test_extension_probe_asks_each_stem_once(spark):
    plan = registry.queries()["extension_probe"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "stem" in plan


def test_lexical_text_is_put_together_once_a_row(spark):
    from graphloom.operators import retrieval
    from graphloom.plans.ranking_queries import MODEL, _nodes
    from graphloom.sources.graph_views import Tables

    plan = retrieval.lexical(_nodes(Tables(spark, DATA)).filter("kind = 'Class'"), MODEL)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("concat_ws") <= 3  # once for each kind of node


def test_edges_of_a_few_nodes(spark):
    from graphloom.sources.graph_views import Tables, edges

    t = Tables(spark, DATA)
    few = spark.createDataFrame([("function:12",), ("function:989",), ("none",)], "from_id string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = rows(edges(t, "CALLS", "DEFINES").filter("from_id IN ('function:12', 'function:989')"))
    assert want and rows(edges(t, "CALLS", "DEFINES", of=few)) == want
