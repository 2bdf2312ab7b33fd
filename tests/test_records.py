"""Records beside a graph, diagnostics of files and symbols, evaluation packs and graph checks."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import diagnostics, evaluation
from graphloom.sources.generations import GraphStore
from graphloom.sources.graph_views import Tables, edges, nodes
from graphloom.sources.records import Records, reused


def test_records(spark, tmp_path):
    records = Records(spark, str(tmp_path))
    assert records.read("x") is None and records.progress() is None and records.events() == [] and records.lock_state() is None
    records.write("x", {"a": [1, "ü"]})
    records.write("x", {"a": [2]})
    assert records.read("x") == {"a": [2]} and sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".json") == ["x.json"]
    records.report("r1", "started", "scan", now=1000.5)
    records.report("r1", "progress", "parse", now=1001.0, counters={"files": 3})
    assert [e["phase"] for e in records.events()] == ["scan", "parse"] and records.events(1)[0]["timestamp"] == "1970-01-01T00:16:41.000Z"
    assert records.progress(1010)["status"] == "running" and records.progress(2000)["status"] == "stale"
    records.report("r1", "completed", "done", now=1002)
    assert records.progress(9999)["status"] == "ended"


def test_write_lock(spark, tmp_path):
    records = Records(spark, str(tmp_path))
    assert records.lock("a", now=100) and not records.lock("b", now=200) and records.lock_state(200) == {"owner": "a", "at": 100, "stale": False}
    assert records.lock("b", now=500) and records.lock_state(500)["owner"] == "b"
    records.unlock("a")
    assert records.lock_state() is not None
    records.unlock("b")
    assert records.lock_state() is None


def test_failures_facts_and_embeddings(spark, tmp_path):
    records = Records(spark, str(tmp_path))
    row = lambda prefix, at, kind="oom", files=None: {"repo": "r", "path_prefix": prefix, "file_paths": files, "failure_kind": kind, "last_failed_at": at}
    records.add_failures([row("a\\b", "1"), row("a/b", "3"), row("a/b", "2"), row(".", "5", files=["y", "x"])])
    records.add_failures([row(".", "4", files=["x", "y"]), row("a/b", "1", "timeout")])
    got = [(r["path_prefix"], r["last_failed_at"], r["failure_kind"], r["file_paths"]) for r in records.failures().collect()]
    assert got == [(".", "5", "oom", ["x", "y"]), ("a/b", "3", "oom", None), ("a/b", "1", "timeout", None)]
    table = spark.createDataFrame([(1, "a")], "n int, s string")
    assert records.facts("g", "h1") is None
    records.keep_facts("g", table, table, "h1")
    assert records.facts("g", "h2") is None and records.facts("g", "h1")[1].collect() == table.collect()
    vectors = spark.createDataFrame([("h1", "m", [1.0]), ("h2", "m", [2.0]), ("h1", "other", [3.0])], "input_hash string, model string, embedding array<double>")
    assert reused(spark.createDataFrame([("i", "h1")], "id string, input_hash string"), records.embeddings(), "m")[0].count() == 0
    records.keep_embeddings(vectors)
    records.keep_embeddings(vectors)
    kept, missing = reused(spark.createDataFrame([("i", "h1"), ("j", "h1"), ("k", "h9")], "id string, input_hash string"), records.embeddings(), "m")
    assert records.embeddings().count() == 3 and {r["id"]: r["embedding"] for r in kept.collect()} == {"i": [1.0], "j": [1.0]} and [r["input_hash"] for r in missing.collect()] == ["h9"]


def test_diagnostics(spark, tmp_path):
    files = spark.createDataFrame([("src/a.ts", "p", "included"), ("src/b.ts", "p", "included"), ("src/c.ts", "p", "included"), ("out", None, "build-artifact")], "path string, package_name string, reason string")
    facts = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string")
    t = Tables(spark, "/root/testdata/sf0.001")
    some = nodes(t, "Function").limit(2).withColumn("file", F.lit("src/a.ts")).withColumn("name", F.lit("go"))
    links = spark.createDataFrame([("src/a.ts", "high")], "owner_file string, confidence string")
    told = diagnostics.lifecycles(files, facts, some, links)
    assert {r["path"]: r["status"] for r in told.collect()} == {"src/a.ts": "indexed", "src/b.ts": "parsed", "src/c.ts": "discovered", "out": "skipped"}
    assert diagnostics.diagnose_file(told, "./a.ts").first()["path"] == "src/a.ts"
    below = diagnostics.diagnose_file(told, "out/deep/x.js").first()
    assert (below["path"], below["reason"]) == ("out/deep/x.js", "build-artifact") and diagnostics.diagnose_file(told, "none.ts").count() == 0
    assert [r["status"] for r in diagnostics.diagnose_symbol(some, told, "GO").collect()] == ["indexed", "indexed"]
    row = diagnostics.summary(told, links).first()
    assert (row["skipped"], row["indexed"], row["edges"], row["high"], row["medium"]) == (1, 1, 1, 1, 0)
    store, records = GraphStore(spark, str(tmp_path)), Records(spark, str(tmp_path))
    assert diagnostics.index_status(store, records)["indexed"] is False
    store.publish(store.write(nodes(t, "File"), edges(t, "DEFINES").limit(0)))
    state = diagnostics.index_status(store, records)
    assert state["indexed"] and state["manifest"]["nodes"] == nodes(t, "File").count() and state["write_lock"] is None


def test_packs_and_rollup(spark, tmp_path):
    gate = {"status": "required", "capability": "lookup", "layer": "query"}
    cases = [
        {"id": "a", "name": "a", "mode": "semantic", "query": "q", "limit": 5, "gate": gate, "expected": [{"file": "x/*.ts"}, {"file": "x/*.ts"}], "notExpected": [{"file": "no.ts"}]},
        {"id": "b", "name": "b", "mode": "callers", "query": "q", "limit": 5, "gate": {**gate, "status": "target"}, "expected": [{"file": "y.ts", "symbol": "s"}], "failureClassHint": "fusion"},
    ]
    (tmp_path / "one.json").write_text(json.dumps({"cases": cases}))
    told = evaluation.load_pack(spark, str(tmp_path))
    assert told.count() == 4
    results = spark.createDataFrame([("a", 1, "x/a.ts", "s", "Function"), ("a", 3, "x/b.ts", "s", "Function"), ("a", 2, "x/y/b.ts", "s", "Function"), ("b", 1, "y.ts", "other", "Class")], "id string, rank int, file string, symbol string, kind string")
    ranks = evaluation.ranked_expectations(told, results)
    assert {(r["id"], r["wanted"], r["n"]): r["rank"] for r in ranks.collect()} == {("a", True, 1): 1, ("a", True, 2): 3, ("a", False, 1): None, ("b", True, 1): None}
    out = evaluation.case_results(ranks)
    assert {r["id"]: (r["status"], r["failure_class"], r["mrr"], r["recall"]) for r in out.collect()} == {"a": ("pass", None, 1.0, 1.0), "b": ("fail", "fusion", 0.0, 0.0)}
    rows = {(r["scope"], r["key"]): (r["total"], r["failed"], r["blocking"]) for r in evaluation.rollup(out).collect()}
    assert rows["all", "all"] == (2, 1, 0) and rows["gate", "target"] == (1, 1, 0) and rows["failure", "fusion"] == (1, 1, 0)


@pytest.mark.parametrize(
    "check,passed",
    [
        ({"type": "edge-exists", "from": {"symbol": "A"}, "to": {"file": "src/**", "kind": "Function"}, "kinds": ["CALLS"], "require_evidence": True}, True),
        ({"type": "edge-exists", "from": {"symbol": "a"}, "to": {"symbol": "c"}}, False),
        ({"type": "no-edge", "from": {"symbol": "a"}, "to": {"symbol": "c"}}, True),
        ({"type": "no-edge", "from": {"symbol": "b"}, "to": {"symbol": "a"}, "direction": "incoming"}, False),
        ({"type": "path-exists", "nodes": [{"symbol": "a"}, {"symbol": "b"}, {"symbol": "c"}]}, True),
        ({"type": "path-exists", "nodes": [{"symbol": "a"}, {"symbol": "zz"}]}, False),
        ({"type": "no-path", "from": {"symbol": "c"}, "to": {"symbol": "a"}}, True),
        ({"type": "no-path", "from": {"symbol": "a"}, "to": {"symbol": "c"}, "depth": 2}, False),
        ({"type": "no-path", "from": {"symbol": "a"}, "to": {"symbol": "zz"}}, True),
    ],
)
def test_graph_checks(spark, check, passed):
    n = spark.createDataFrame([(x, "Function", f"src/{x}.ts", x) for x in "abc"], "id string, kind string, file string, name string")
    e = spark.createDataFrame([("CALLS", "a", "b", "syntax", "high", []), ("CALLS", "b", "c", "syntax", "high", [])], "kind string, from_id string, to_id string, origin string, confidence string, evidence array<string>")
    assert evaluation.graph_check(n, e, check)["passed"] is passed


def test_facts_of_cases(spark):
    assert evaluation.partial_match({"a": 1, "b": {"c": "hello", "d": 2}}, {"b": {"c": "/^hel/"}}) and not evaluation.partial_match({"a": 1}, {"a": 2})
    facts = spark.createDataFrame([("a.ts", "call", "go", 3), ("b.ts", "call", "run", None)], "path string, kind string, name string, line int")
    checks = [{"path": "a.ts", "where": {"kind": "call", "line": "3"}}, {"where": {"name": "run", "line": None}}, {"path": "b.ts", "where": {"name": "go"}, "wanted": False}, {"where": {"name": "go"}, "wanted": False}]
    assert [(r["found"], r["passed"]) for r in evaluation.fact_checks(facts, checks).orderBy("n").collect()] == [(1, True), (1, True), (0, True), (1, False)]
