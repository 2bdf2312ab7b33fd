"""The command line from an indexed tree to answers and an evaluation pack."""

import json
import os

import pytest

from graphloom.__main__ import main, parser
from graphloom.plans.tree_queries import TREE


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    for path, text in TREE.items():
        os.makedirs(at / "tree" / os.path.dirname(path), exist_ok=True)
        (at / "tree" / path).write_text(text)
    assert main(["--graph", str(at / "g"), "index", str(at / "tree")], spark) == 0
    return at


def said(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_answers(graph, spark, capsys):
    g = str(graph / "g")
    assert main(["--graph", g, "status"], spark) == 0
    state = said(capsys)[-1]
    assert state["indexed"] and state["progress"]["status"] == "ended" and state["write_lock"] is None
    main(["--graph", g, "callers", "total"], spark)
    assert {r["name"] for r in said(capsys)} == {"count", "GET", "put"}
    main(["--graph", g, "references", "Item"], spark)
    rows = said(capsys)
    assert rows[-1]["definition"] and rows[-1]["name"] == "Item" and {r["name"] for r in rows[:-1]} == {"add", "put"}  # one a file
    main(["--graph", g, "callees", "Cart"], spark)
    said(capsys)
    main(["--graph", g, "health"], spark)
    assert all(r["wrong"] == 0 for r in said(capsys))


def test_eval(graph, spark, capsys):
    gate = {"status": "required", "capability": "callers", "layer": "query"}
    case = {"id": "a", "name": "a", "mode": "callers", "query": "total", "limit": 5, "gate": gate, "expected": [{"file": "**/store.ts", "symbol": "count"}]}
    os.makedirs(graph / "pack", exist_ok=True)
    (graph / "pack/cases.json").write_text(json.dumps({"cases": [case, {**case, "id": "b", "mode": "find-symbol", "query": "Store", "expected": [{"file": "packages/core/src/store.ts", "symbol": "Store", "maxRank": 1}]}]}))
    assert main(["--graph", str(graph / "g"), "eval", str(graph / "pack")], spark) == 0
    rows = {(r["scope"], r["key"]): (r["total"], r["passed"]) for r in said(capsys)}
    assert rows["all", "all"] == (2, 2)
    assert parser().parse_args(["--graph", "x", "path", "a", "b"]).depth == 4
