import os

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators.building import index_workspace, joined_path
from graphloom.sources.generations import GraphStore

TREE = {
    "package.json": '{"name": "root"}',
    "packages/core/package.json": '{"name": "@s/core"}',
    "packages/core/src/index.ts": "export { total } from './sum';\nexport class Base {}\n",
    "packages/core/src/sum.ts": "export function total(xs) {\n  return xs.reduce(add, 0) + add(1, 2);\n}\nfunction add(a, b) { return a + b; }\n",
    "packages/core/src/sum.test.ts": "import { total } from './sum';\ntest('adds', () => { total([1]); });\n",
    "packages/app/package.json": '{"name": "app"}',
    "packages/app/main.ts": "import { total as t } from '../core/src/sum';\nimport { Base } from '@s/core';\nimport x from 'react';\nimport './none';\nexport class Main extends Base implements Runs {\n  go() { return t([process.env.LIMIT]); }\n}\ninterface Runs {}\n",
    "packages/app/lone.ts": "export const lone = () => 1;\n",
    "packages/app/lone.test.ts": "it('stands alone', () => {});\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("ws")
    for path, text in TREE.items():
        os.makedirs(at / os.path.dirname(path), exist_ok=True)
        (at / path).write_text(text)
    return at


def edges_of(edges):
    return {(r["kind"], r["from_id"].split(":", 1)[1].split("#")[-1], r["to_id"].split(":", 1)[1].split("#")[-1]) for r in edges.collect()}


def test_paths(spark):
    got = spark.range(1).select(joined_path(F.lit("a/b/c.ts"), F.lit("../d/./e")).alias("x"), joined_path(F.lit("c.ts"), F.lit("./e")).alias("y")).first()
    assert (got["x"], got["y"]) == ("a/d/e", "e")


def test_graph(spark, root, tmp_path):
    nodes, edges, files, facts = index_workspace(spark, str(root))
    got = edges_of(edges)
    assert ("CALLS", "total:1", "add:4") in got and ("CALLS", "go:6", "total:1") in got
    assert ("EXTENDS", "Main:5", "Base:2") in got and ("IMPLEMENTS", "Main:5", "Runs:8") in got
    assert ("IMPORTS", "packages/app/main.ts", "packages/core/src/sum.ts") in got and ("IMPORTS", "packages/app/main.ts", "packages/core/src/index.ts") in got
    assert ("TESTS", "packages/core/src/sum.test.ts", "total:1") in got and ("TESTS", "packages/app/lone.test.ts", "packages/app/lone.ts") in got
    assert ("REFERENCES", "packages/app/main.ts", "LIMIT") in got
    store = GraphStore(spark, str(tmp_path))
    store.publish(store.write(nodes, edges))
    engine = Engine(*store.open())
    assert {r["name"] for r in engine.callers("total").collect()} == {"go"}
    assert "return xs.reduce" in engine.get_context(engine.find_symbol("total").first()["id"]).first()["excerpt"]

    (root / "packages/app/lone.ts").write_text("import { total } from '../core/src/sum';\nexport const lone = () => total([]);\n")
    at = str(tmp_path / "kept")
    files.write.parquet(f"{at}/files")
    facts.write.parquet(f"{at}/facts")
    again = index_workspace(spark, str(root), known=(spark.read.parquet(f"{at}/files"), spark.read.parquet(f"{at}/facts")))
    whole = index_workspace(spark, str(root))
    assert edges_of(again[1]) == edges_of(whole[1]) and again[3].exceptAll(whole[3]).isEmpty() and whole[3].exceptAll(again[3]).isEmpty()
