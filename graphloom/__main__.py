"""Command line: index a source tree into a graph's folder, and ask it. Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from graphloom.engine import Engine
from graphloom.operators import diagnostics
from graphloom.operators.building import index_workspace
from graphloom.operators.evaluation import run_suite
from graphloom.sources.generations import GraphStore
from graphloom.sources.records import Records

#: Questions by name: the engine's method and what it is asked with.
ASKS = {"find": "find_symbol", "callers": "callers", "callees": "callees", "references": "references", "relationships": "relationships", "context": "get_context", "search": "search_text", "semantic": "semantic_search"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    top.add_argument("--graph", required=True, help="folder of the graph, on any file system Spark reads")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("index", help="index a source tree and publish it").add_argument("tree")
    for name in ASKS:
        ask = commands.add_parser(name)
        ask.add_argument("query")
        ask.add_argument("--limit", type=int, default=10)
    path = commands.add_parser("path", help="the best path between two nodes")
    path.add_argument("start")
    path.add_argument("goal")
    path.add_argument("--depth", type=int, default=4)
    for name in ("status", "health"):
        commands.add_parser(name)
    commands.add_parser("eval", help="run a pack of cases").add_argument("pack")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    told = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    store, records = GraphStore(spark, told.graph), Records(spark, told.graph)
    show = lambda df: print("\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in df.collect()))
    if told.command == "status":
        print(json.dumps(diagnostics.index_status(store, records)))
        return 0
    if told.command == "index":
        with records.writing("command line"):
            records.report("index", "started", "index")
            try:
                nodes, edges, _, _ = index_workspace(spark, told.tree)
                store.publish(name := store.write(nodes, edges))
            except Exception as e:
                records.report("index", "failed", "index", message=str(e)[:500])
                raise
            records.report("index", "completed", "index", generation=name)
        print(json.dumps({"generation": name}))
        return 0
    engine = Engine(*store.open())
    if told.command == "path":
        show(engine.trace_path(told.start, told.goal, told.depth))
    elif told.command == "health":
        show(engine.health())
    elif told.command == "eval":
        results, rows = run_suite(engine, told.pack)
        show(rows)
        return 0 if results.filter("status = 'fail' AND gate = 'required'").isEmpty() else 1
    else:
        show(getattr(engine, ASKS[told.command])(told.query, limit=told.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
