"""Path searches against recursive SQL and plain loops, and path candidates of the ranking."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import path_ranking, retrieval, traversal
from graphloom.sources.graph_views import NODE_COLUMNS


def graph(spark, n=14, m=34, seed=3):
    rng = random.Random(seed)
    pairs = rng.sample([(a, b) for a in range(n) for b in range(n) if a != b], m)
    return [(a, b, rng.choice([1, 10, 30, 40])) for a, b in pairs]


def every_path(rows, start, goal, depth, closed=(), forbidden=()):
    out = {}
    for a, b, w in rows:
        out.setdefault(a, []).append((b, w))
    best = None
    stack = [(start,)]
    while stack:
        path = stack.pop()
        if len(path) > 1 and path[-1] == goal:
            score = sum(max(w for b, w in out[x] if b == y) - k for k, (x, y) in enumerate(zip(path, path[1:]), 1))
            new = (-score, len(path) - 1, path)
            best = new if best is None or new < best else best
            continue
        if len(path) - 1 < depth and (len(path) == 1 or path[-1] not in closed):
            stack += [(*path, b) for b, _ in out.get(path[-1], ()) if b not in path and b not in forbidden]
    return best


def test_best_first_finds_a_path_where_there_is_one(spark):
    rows = graph(spark)
    edges = spark.createDataFrame(rows, "from_id long, to_id long, weight long")
    pairs = spark.createDataFrame([(a, b) for a in range(0, 14, 3) for b in range(14)], "start long, goal long")
    closed = {2, 5}
    got = {(r["start"], r["goal"]): r for r in traversal.best_first(edges, pairs, 3, closed=spark.createDataFrame([(c,) for c in closed], "id long")).collect()}
    for a, b in itertools.product(range(0, 14, 3), range(14)):
        best = None if a == b else every_path(rows, a, b, 3, closed)
        assert ((a, b) in got) == (best is not None), (a, b)
        if best:  # the search enters a node once unless nearer, so its path may be worth less, never more
            path = tuple(map(int, got[a, b]["path"].split(">")))
            assert got[a, b]["score"] <= -best[0] and path[0] == a and path[-1] == b and not closed & set(path[1:-1])


def test_full_depth_is_no_step(spark):
    rows = [(0, k, 40) for k in range(1, 6)] + [(k, 10 + k, 40) for k in range(1, 6)] + [(0, 9, 1), (9, 99, 1)]
    edges = spark.createDataFrame(rows, "from_id long, to_id long, weight long")
    pairs = spark.createDataFrame([(0, 99)], "start long, goal long")
    assert traversal.best_first(edges, pairs, 2, most_steps=7).count() == 1 and traversal.best_first(edges, pairs, 2, most_steps=6).count() == 0


def test_ordered_paths(spark):
    rows = [("a", "b", 10), ("b", "c", 10), ("c", "d", 10), ("a", "x", 40), ("x", "d", 40), ("d", "b", 1), ("s", "b", 5)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, weight long")
    groups = [(1, 0, "a"), (1, 1, "b"), (1, 2, "d"), (2, 0, "a"), (2, 1, "d"), (2, 2, "c"), (3, 0, "a"), (3, 0, "s"), (3, 1, "b"), (4, 0, "d"), (4, 1, "a")]
    got = {r["seq"]: tuple(r["path"]) for r in traversal.ordered_paths(edges, spark.createDataFrame(groups, "seq int, place int, id string"), 2).collect()}
    assert got == {1: ("a", "b", "c", "d"), 2: ("a", "x", "d", "b", "c"), 3: ("a", "b")}


@pytest.fixture(scope="module")
def app(spark):
    """A small application: a route that calls a service, which writes to the database; a test; a page; a package."""
    node = lambda id_, kind, file, name, file_kind="source": (id_, kind, "r", "web", file, name, file_kind, kind, name, True, "syntax", None)
    rows = [
        node("package:web", "Package", None, "web", None),
        node("file:route", "File", "apps/web/app/api/orders/route.ts", "route.ts"),
        node("post", "Function", "apps/web/app/api/orders/route.ts", "POST"),
        node("create", "Function", "apps/web/src/orderService.ts", "createOrder"),
        node("prisma", "Symbol", "apps/web/src/database.ts", "prisma"),
        node("page", "Function", "apps/web/app/orders/page.tsx", "Page"),
        node("spec", "Function", "apps/web/src/orderService.test.ts", "makesOrders", "test"),
        node("util", "Function", "apps/web/src/text.ts", "pad"),
    ]
    nodes = spark.createDataFrame([r[: len(NODE_COLUMNS)] for r in rows], ", ".join(f"{c} {'boolean' if c == 'exported' else 'string'}" for c in NODE_COLUMNS))
    edge = lambda kind, a, b, evidence, confidence="high": (kind, a, b, "r", "syntax", confidence, evidence, None)
    links = [
        edge("CONTAINS", "package:web", "file:route", []),
        edge("CONTAINS", "package:web", "util", []),
        edge("DEFINES", "file:route", "post", []),
        edge("CALLS", "post", "create", ["call-syntax", "module-resolution"]),
        edge("CALLS", "create", "prisma", ["compiler"]),
        edge("TESTS", "spec", "create", ["test-syntax"]),
        edge("CALLS", "page", "util", ["call-syntax"], "medium"),
    ]
    edges = spark.createDataFrame(links, "kind string, from_id string, to_id string, repo string, origin string, confidence string, evidence array<string>, owner_file string")
    return Engine(nodes, edges)


def test_paths_of_the_ranking(app, spark):
    model = retrieval.query_model("api route that creates an order in the database")
    assert model.intent == "app-flow" and path_ranking.applies(model)
    starts = spark.createDataFrame([("post", 1)], "id string, seed int")
    got = path_ranking.paths(app.nodes, app.edges, starts, model).collect()
    by = {tuple(r["ids"]): r["score"] for r in got}
    # roles: post = route + service (handler in no name) + executable; create = service + executable; prisma = database + executable
    told = {r["id"]: (r["role"], r["c"]) for r in app.nodes.select("id", path_ranking.role(model).alias("role"), path_ranking.concepts(model).alias("c")).collect()}
    assert told["post"][0] == pytest.approx(0.9 + 0.34) and told["create"][0] == pytest.approx(0.52 + 0.34) and told["prisma"][0] == pytest.approx(0.52 + 0.34)
    call = 0.72 + 0.28 + 0.34 + 0.28
    both = set(told["post"][1]) | set(told["create"][1])
    assert by["post", "create"] == pytest.approx(told["post"][0] + told["create"][0] + call + 0.14 * len(both) - 0.1)
    assert ("post", "create", "prisma") in by and ("post", "create", "spec") in by and all(len(set(p)) == len(p) for p in by)


def test_semantic_search_by_intent(app):
    flow = app.semantic_search("api route that creates an order in the database", 5).collect()
    assert flow[0]["id"] in ("file:route", "post") and flow[0]["paths"] and all(r["intent"] == "app-flow" for r in flow)
    signals = {x["signal"] for r in flow for x in r["reasons"]}
    assert {"path_app_flow", "app_flow_route", "edge_calls"} <= signals
    tests = app.semantic_search("test suite for orderService", 5).collect()
    assert tests[0]["intent"] == "test" and {"spec", "create"} <= {r["id"] for r in tests}
    assert {r["id"] for r in tests if "test_pair=" in r["sources"]} == {"create"}
    callers = app.semantic_search("callers of createOrder", 5).collect()
    assert {r["id"] for r in callers[:2]} == {"post", "prisma"} and any(x["signal"] == "relationship_intent_demotes_seed_symbol" for r in callers for x in r["demoted"])
    assert app.semantic_search("callers of createOrder", 5, file_kind="test").collect()[0]["id"] == "spec"
    assert app.semantic_search("createOrder", 5, package_name="none").count() == 0


def test_engine_paths(app):
    assert app.trace_path("file:route", "util", 4).count() == 0  # the only way is through the package
    assert app.trace_path("file:route", "util", 4, through_packages=True).first()["path"] == "file:route>package:web>util"
    assert app.trace_path("post", "prisma", 4, require_evidence={"all_of": ["compiler"]}).count() == 0
    assert app.trace_path("post", "prisma", 4, require_evidence={"any_of": ["compiler", "call-syntax"]}).first()["score"] == (40 + 25 + 10 + 20 - 1) + (40 + 40 + 10 + 20 - 2)
    assert app.trace_through([["file:route"], ["create"], ["prisma"]]).first()["path"] == ["file:route", "post", "create", "prisma"]
    fits = {True: 7, None: 7}
    for require, n in fits.items():
        assert app.edges.filter(traversal.evidence_fits(require)).count() == n
    assert app.edges.filter(traversal.evidence_fits({"any_of": []})).count() == 0 and app.edges.filter(traversal.evidence_fits({"all_of": []})).count() == 7
    assert app.edges.filter(F.col("kind") == "TESTS").select(traversal.evidence_of().alias("e")).first()["e"] == ["syntax", "test-syntax"]


def test_one_search_answers_for_all_goals():
    rng = random.Random(5)
    for n, m, most in ((6, 12, 5000), (9, 30, 5000), (9, 30, 7), (40, 60, 5000)):
        for _ in range(60):
            pairs = rng.sample([(a, b) for a in range(n) for b in range(n) if a != b], m)
            out = traversal._out((a, b, rng.choice([1, 10, 30, 40])) for a, b in pairs)
            want = [(g, best) for g in range(n) if g and (best := traversal._search(0, {g}, set(), out, 4, most))]
            assert traversal._search_each(0, list(range(n)), out, 4, most) == want


def test_most_goals_need_no_search_of_their_own(monkeypatch):
    n, calls, search = 100_000, [], traversal._search
    monkeypatch.setattr(traversal, "_search", lambda *a: calls.append(1) or search(*a))
    out = traversal._out(e for i in range(n) for e in ((i, (i * 17 + 11) % n, 30), (i, (i + 1) % n, 40)))
    goals = sum(len(traversal._search_each(start, list({b for x in _near(out, start, 3) for b, _ in out[x]}), out, 4, 5000)) for start in range(0, n, 1000))
    assert goals > 2800 and len(calls) < goals / 10


def _near(out, start, depth):
    near = {start}
    for _ in range(depth):
        near |= {b for a in near for b, _ in out[a]}
    return near


def test_without_goals_all_nodes_in_reach_are_goals(spark):
    rows = graph(spark)
    edges = spark.createDataFrame(rows, "from_id long, to_id long, weight long")
    starts = spark.createDataFrame([(a,) for a in range(14)], "start long")
    pairs = starts.crossJoin(starts.withColumnRenamed("start", "goal"))
    of = lambda asked: sorted(tuple(r) for r in traversal.best_first(edges, asked, 3).collect())
    assert of(starts) == of(pairs) and of(starts)


def test_chains_cost_rounds_by_their_length_not_by_the_number_of_modules(spark, monkeypatch):
    cuts, cut = [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: cuts.append(1) or cut(df))
    n = 4096  # circles of 3 with a tail of one each, and chains of one
    target = lambda i: None if i % 8 == 0 else i + 1 if i % 8 in (1, 2, 4) else i - 2 if i % 8 == 3 else i - 5 if i % 8 == 5 else i - 6
    rows = [(i, target(i)) for i in range(n)]
    want = []
    for i in range(n):
        seen = [i]
        while (t := target(seen[-1])) is not None and t not in seen:
            seen.append(t)
        want.append((i, seen[-1] if t is None else None, len(seen)))
    modules = spark.range(n).select(F.col("id").alias("f"))
    got = traversal.chains(modules, spark.createDataFrame([r for r in rows if r[1] is not None], "f long, target long")).select("origin", "last", "depth").collect()
    assert sorted(map(tuple, got)) == want and len(cuts) < 16
