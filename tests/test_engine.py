import json

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.sources.graph_views import Tables, edges, nodes
from graphloom.streaming.events import counts, read_events, runs


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    t = Tables(spark, "/root/testdata/sf0.001")
    at = str(tmp_path_factory.mktemp("graph"))
    nodes(t).write.parquet(f"{at}/n")
    edges(t, "CONTAINS", "DEFINES", "CALLS", "REFERENCES").write.parquet(f"{at}/e")
    return Engine(spark.read.parquet(f"{at}/n"), spark.read.parquet(f"{at}/e"))


def test_lookup_and_relations(engine):
    found = engine.find_symbol("handle12", 5).collect()
    assert found and all("handle12" in r["name"] for r in found)
    callees = engine.callees("function:3").collect()
    want = {r["to_id"] for r in engine.edges.filter("kind = 'CALLS' AND from_id = 'function:3'").collect()}
    assert {r["id"] for r in callees} == want
    some = callees[0]["id"]
    assert engine.edges.filter(F.col("to_id") == some).select("from_id").distinct().count() >= engine.callers(some, 50).count() > 0
    assert engine.relationships("function:3", ["CALLS"], 50).count() == len(want)


def test_paths_and_context(engine):
    got = engine.trace_path("function:3", "file:0", 3).collect()
    assert len(got) <= 1 and engine.trace_path("function:3", "function:3").count() == 0
    owner = engine.edges.filter("kind = 'DEFINES' AND to_id = 'function:3'").first()["from_id"]
    path = engine.trace_path("function:3", owner, 1, ("DEFINES",)).first()
    assert path["path"] == f"function:3>{owner}" and path["hops"] == 1
    near = engine.expand_context("function:3", 1, 50).collect()
    assert near[0]["id"] == "function:3" and {r["depth"] for r in near} == {0, 1}


def test_search(engine):
    rows = engine.semantic_search("where is handle12 called", 5).collect()
    assert 0 < len(rows) <= 5 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert any("symbol=" in r["sources"] for r in rows)
    pattern = engine.nodes.filter("kind = 'Chunk' AND length(content) > 60").first()["content"].split("\n")[0][:30]
    hits = engine.search_text(pattern).collect()
    assert hits and all(pattern in r["line"] for r in hits)


def test_health(engine):
    assert {r["check"]: r["wrong"] for r in engine.health().collect()} == {"nodes with a repeated id": 0, "edges without an end": 0, "edges of unknown kind": 0}


def test_event_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda run, minute, phase: json.dumps({"runId": run, "event": "progress", "phase": phase, "timestamp": f"2024-01-01T00:{minute:02d}:00Z"})
    (folder / "1.json").write_text("\n".join([line("a", 0, "scan"), line("b", 1, "scan"), "not json"]))
    query = runs(read_events(spark, str(folder))).writeStream.format("memory").queryName("runs_out").outputMode("append").start()
    query.processAllAvailable()
    (folder / "2.json").write_text("\n".join([line("a", 20, "write"), line("b", 2, "completed")]))
    query.processAllAvailable()
    (folder / "3.json").write_text(line("c", 40, "scan"))
    query.processAllAvailable()
    query.stop()
    rows = [tuple(r) for r in spark.table("runs_out").select("runId", "phase", "events", "status").collect()]
    assert ("a", "scan", 1, "running") in rows and ("b", "completed", 2, "completed") in rows and ("a", "write", 2, "stale") in rows
    assert not any(r[0] == "b" and r[3] == "stale" for r in rows)
    batch = {(r["event"], r["n"]) for r in counts(read_events(spark, str(folder), streaming=False)).collect()}
    assert ("progress", 3) in batch or ("progress", 2) in batch
