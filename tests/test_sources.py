import os

import pytest

from graphloom.operators.extraction import contained, extract_facts, facts_of
from graphloom.sources.generations import GraphStore
from graphloom.sources.graph_views import Tables, edges, nodes
from graphloom.sources.workspace import Policy, discover, package_manager, parse_jsonc, scan

TREE = {
    "package.json": '{"name": "root", // top\n "dependencies": {"a": "1"}, "devDependencies": {"a": "2",},}',
    "yarn.lock": "# lock",
    "src/main.ts": "import { x as y } from './lib';\nexport function run() {\n  return y(1);\n}\n",
    "src/lib.ts": "export const x = (n: number) => n + 1;\n",
    "src/lib.test.ts": "describe('lib', () => { it('adds', () => { x(1); }); });\n",
    "packages/core/package.json": '{"name": "@scope/core"}',
    "packages/core/index.js": "module.exports = { a: require('a') };\n",
    "node_modules/a/index.js": "x",
    "src/types.d.ts": "declare const z: number;",
    "notes.md": "# no",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_discovery(spark, tree):
    rows = {r["path"]: r for r in discover(spark, tree, Policy(exclude=("src/lib*.ts",))).collect()}
    assert set(rows) == set(TREE)
    assert rows["src/main.ts"]["reason"] == "included" and rows["src/main.ts"]["package_name"] == "root"
    assert rows["packages/core/index.js"]["package_name"] == "@scope/core"
    assert rows["node_modules/a/index.js"]["reason"] == "build-artifact" and rows["src/types.d.ts"]["reason"] == "generated"
    assert rows["notes.md"]["reason"] == "unsupported-extension" and rows["src/lib.ts"]["reason"] == "config-excluded"
    assert rows["src/lib.test.ts"]["reason"] == "included" and rows["src/lib.test.ts"]["file_kind"] == "test"
    assert package_manager(scan(spark, tree)) == "yarn"
    assert parse_jsonc('{"a": "// no", /* yes */ "b": [1,],}') == {"a": "// no", "b": [1]}


def test_facts():
    found = facts_of(
        """import def, { a as b, type C } from 'm'; // import q from 'no'
import * as ns from "n";
import './side';
const { r1, r2 } = require('r');
export { b as c } from './d';
export * from './e';
export default class Foo extends Bar {
  go() { return this.x.run?.(1) + new Baz(`t`) }
}
export async function act() { await import('./dyn'); const s = "call()"; tag`x`; process.env.KEY; }
test('does it', () => {});
"""
    )
    of = lambda kind: [(f[1], f[2], f[3]) for f in found if f[0] == kind]
    assert set(of("import")) == {("def", "default", "m"), ("b", "a", "m"), ("C", "C", "m"), ("ns", "*", "n"), (None, "side-effect", "./side"), ("r1", "require", "r"), ("r2", "require", "r"), (None, "dynamic", "./dyn")}
    assert set(of("export")) == {("c", "b", "./d"), ("*", "star", "./e"), ("default", "default", None), ("act", "local", None)}
    calls = of("call")
    assert ("Baz", "constructor", "Baz") in calls and ("tag", "tagged-template", "tag") in calls and not any(c[0] == "call" for c in calls)
    assert ("KEY", "env", "process.env.KEY") in of("member") and of("test") == [("does it", "test", None)]
    assert {(n, d) for n, d, _ in of("declaration")} >= {("Foo", "class"), ("act", "function")}


def test_extraction_and_containment(spark, tree):
    facts = extract_facts(discover(spark, tree))
    rows = {(r["path"], r["owner"], r["callee"]) for r in contained(facts).collect()}
    assert ("src/main.ts", "run", "y") in rows
    assert extract_facts(spark.createDataFrame([("a", None), ("b", "")], "path string, text string")).count() == 0


def test_generations(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    store = GraphStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.open()
    n, e = nodes(t, "File", "Function"), edges(t, "DEFINES")
    first = store.write(n, e)
    store.publish(first)
    opened = store.open()
    second = store.write(n.filter("kind = 'File'"), e.limit(0))
    store.publish(second)
    assert store.active() == second and opened[0].count() == n.count() and opened[1].count() == e.count()
    assert store.open()[0].count() == n.filter("kind = 'File'").count()
    with pytest.raises(ValueError):
        store.write(n.filter("kind = 'File'"), e)
    assert store.active() == second
