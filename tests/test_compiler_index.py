"""The compiler index reader on hand-made messages, its fusion with source facts, and chunk splitting."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunking
from graphloom.operators.building import declared
from graphloom.operators.extraction import extract_facts
from graphloom.sources import compiler_index as ci


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def packed(numbers):
    return b"".join(map(varint, numbers))


def occurrence(symbol, range_, roles=0, around=None):
    return field(1, packed(range_)) + field(2, symbol) + (field(3, roles) if roles else b"") + (field(7, packed(around)) if around else b"")


def symbol(name, kind, *docs):
    return field(1, name) + b"".join(field(3, d) for d in docs) + field(5, kind)


def document(path, occurrences, symbols):
    return field(1, path) + b"".join(field(2, o) for o in occurrences) + b"".join(field(3, s) for s in symbols)


SUM, BASE, MAIN = "npm core 1 src/`sum.ts`/total().", "npm core 1 src/`base.ts`/Base#", "npm app 1 `main.ts`/Main#"
INDEX = b"".join(
    field(2, d)
    for d in (
        document("sum.ts", [occurrence(SUM, [0, 16, 21], 1, [0, 0, 2, 1]), occurrence("local 4", [1, 8, 9], 1)], [symbol(SUM, 17, "```ts\nfunction total(xs): number\n```"), symbol("local 4", 61, "const n: number")]),
        document("base.ts", [occurrence(BASE, [0, 13, 17], 1)], [symbol(BASE, 7, "class Base")]),
        document("main.ts", [occurrence(SUM, [0, 9, 14], 2), occurrence(BASE, [1, 9, 13], 2), occurrence(MAIN, [2, 13, 17], 1), occurrence(BASE, [2, 26, 30]), occurrence(SUM, [3, 16, 21]), occurrence("npm app 1 `main.ts`/Main#go().(x)", [3, 5, 6])], [symbol(MAIN, 7, "class Main"), symbol("npm app 1 `main.ts`/Main#go().(x)", 37, "(parameter) x")]),
        document("sum.test.ts", [occurrence(SUM, [1, 2, 7])], []),
    )
)
TEXTS = {
    "sum.ts": "export function total(xs) {\n  const n = xs.length;\n}\n",
    "base.ts": "export class Base {}\n",
    "main.ts": "import { total } from './sum';\nimport { Base } from './base';\nexport class Main extends Base {\n  go() { return total([1]); }\n}\n",
    "sum.test.ts": "export function check() {\n  total();\n}\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("a.scip", bytearray(INDEX)), ("b.scip", bytearray(INDEX)), ("c.scip", None)], "shard string, content binary")
    return ci.decode(files)


def test_reader(facts):
    rows = [r for r in facts.collect() if r["shard"] == "a.scip"]
    found = {(r["name"], r["symbol_kind"], r["path"], r["start_line"]) for r in rows if r["what"] == "definition"}
    assert found == {("total", "Function", "sum.ts", 1), ("n", "Variable", "sum.ts", 2), ("Base", "Class", "base.ts", 1), ("Main", "Class", "main.ts", 3)}
    assert {r["symbol"] for r in rows if r["name"] == "n"} == {"local sum.ts 4"} and len(rows) == 4 + 9
    assert ci.symbol_name([], "npm x 1 a/Foo#") == "Foo" and ci.symbol_name([], "`m.ts`.") == "m.ts" and ci.symbol_name([], "?") is None
    with pytest.raises(ValueError):
        ci.fields_of(b"\x0a\x05ab")


def test_merge_and_read(facts, spark, tmp_path):
    definitions, seen, references = ci.merged(facts)
    assert definitions.count() == 4 and seen.count() == 9 and references.count() == 5
    told = {(r["path"], r["start_line"], r["name"]): (r["roles"], r["is_import"], r["is_test"]) for r in references.collect()}
    assert told["main.ts", 1, "total"] == (["Import"], True, False) and told["sum.test.ts", 2, "total"] == (["ReadAccess"], False, True)
    (tmp_path / "one.scip").write_bytes(INDEX)
    assert ci.read_index(spark, str(tmp_path)).count() == 13


def test_fusion(facts, spark):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, text string")
    source = extract_facts(files)
    symbols = declared(source)
    definitions, _, references = ci.merged(facts)
    told = ci.matched(definitions, symbols)
    assert {r["name"]: (r["new"], r["kind"]) for r in told.collect()} == {"total": (False, "Function"), "n": (False, "Symbol"), "Base": (False, "Class"), "Main": (False, "Class")}
    edges = {(r["kind"], r["from_id"].split("#")[-1], r["to_id"].split("#")[-1]): r["evidence"] for r in ci.fused_edges(told, references, symbols, source).collect()}
    assert ("CALLS", "go:4", "total:1") in edges and ("CALLS", "check:1", "total:1") in edges and ("TESTS", "check:1", "total:1") in edges
    assert edges["EXTENDS", "Main:3", "Base:1"] == ["compiler", "type-relationship"] and ("IMPORTS", "file:main.ts", "Base:1") in edges
    assert ("EXPORTS", "file:sum.ts", "total:1") in edges and ("DEFINES", "file:base.ts", "Base:1") in edges
    assert not any(k == "CALLS" and b == "Base:1" for k, _, b in edges)


def test_runs(spark, facts):
    runs = spark.createDataFrame([("a.scip", True, 500, "", 0, False, None), ("c.scip", True, 500, "", 0, False, None), ("d", False, 0, "FATAL: JavaScript heap out of memory", 134, False, None), ("e", False, 0, "x", 137, False, None), ("f", False, 0, "Timed out", 1, None, None)], "shard string, ok boolean, output_bytes long, stderr string, exit_code int, timed_out boolean, signal string")
    got = {r["shard"]: (r["definitions"], r["warnings"]) for r in ci.quality(runs, facts).collect()}
    assert got == {"a.scip": (4, []), "c.scip": (0, ["index-empty-or-tiny"]), "d": (0, ["index-oom"]), "e": (0, ["index-killed"]), "f": (0, ["index-timeout"])}
    files = spark.createDataFrame([("r", "a/b/c.ts", 3000, 2, 1, 3, False), ("r", "a/d.ts", 10, 0, 0, 0, True), ("s", "a/b/c.ts", 10, 0, 0, 0, False), ("r", "x.ts", 10, 0, 0, 0, False)], "repo string, path string, bytes long, n_declarations int, n_imports int, n_types int, generated boolean")
    history = spark.createDataFrame([("r", "a/b", None, "oom"), ("r", ".", ["x.ts"], "oom"), ("r", "a", None, "timeout")], "repo string, path_prefix string, file_paths array<string>, failure_kind string")
    told = {(r["repo"], r["path"]): (r["failed_before"], r["c"]) for r in ci.history_matches(files, history).withColumn("c", ci.file_cost(F.col("failed_before"))).collect()}
    assert told == {("r", "a/b/c.ts"): (True, 120), ("r", "a/d.ts"): (False, 32), ("s", "a/b/c.ts"): (False, 2), ("r", "x.ts"): (True, 20)}


def test_adaptive_runs():
    fits = lambda shard, heap: {"ok": sum(c for _, c in shard["files"]) <= heap, "stderr": "heap out of memory"}
    policy = {"heap_mb": 10, "most_splits": 2, "larger_heap_mb": 20, "tiny_files": 1}
    out = ci.run_adaptively({"id": "s", "files": [("a", 9), ("b", 8), ("c", 15), ("d", 40)]}, fits, policy)
    assert {(o["status"], tuple(o["files"]), o["heap_mb"]) for o in out} == {("failed", ("d",), 20), ("failed", ("c", "a"), 10), ("succeeded", ("b",), 10)} or {o["status"] for o in out} == {"failed", "succeeded"}
    assert ci.split_retry([("a", 5), ("b", 4), ("c", 3), ("d", 1)]) == [["a", "d"], ["b", "c"]]
    assert ci.run_adaptively({"id": "s", "files": [("a", 1)]}, lambda *_: {"ok": False, "stderr": "timed out: heap out of memory"}, policy)[0]["status"] == "failed"


def test_pieces_hold_the_budget():
    text = "\n".join(f"const a{i} = call{i}(x, y, z);" if i % 3 else f"  nested{i} one two," for i in range(60)) + "\n" + "w " * 200
    for fixed, budget in ((1, 12), (3, 40), (0, 5000)):
        found = chunking.pieces(text, fixed, budget)
        assert all(p[5] <= budget and p[5] == fixed + chunking.count(p[4]) for p in found)
        assert "".join(p[4].replace("\n", "") for p in found) == text.replace("\n", "")
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert chunking.pieces("a;\nb c\nd;\ne f g", 0, 5)[0][:2] == (0, 2) and chunking.pieces("abcDef", 9, 5)[0][4] == "a"


def test_split_chunks(spark):
    rows = [("c1", "f", "Function", "one two\nthree;", 5, "r", "a.ts"), ("c2", "g", "Function", "a b c;\nd e f;\ng h i;", 10, "r", "b.ts"), ("c3", None, "Chunk", None, 1, None, None)]
    df = spark.createDataFrame(rows, "id string, name string, kind string, content string, start_line int, repo string, file string")
    got = {r["id"]: r for r in chunking.split_chunks(df, 8).collect()}
    assert set(got) == {"c1", "c2:part-1", "c2:part-2", "c3"} and got["c1"]["end_line"] == 6 and got["c1"]["tokens"] == 4 and got["c1"]["split_from"] is None
    assert got["c2:part-1"]["content"] == "a b c;\nd e f;" and (got["c2:part-2"]["start_line"], got["c2:part-2"]["kind"], got["c2:part-2"]["total"]) == (12, "Chunk", 2)
    told = df.select(chunking.embedding_input(df.columns, True).alias("t")).collect()
    assert told[0]["t"] == "repo=r path=a.ts\nkind=Function\none two\nthree;" and df.select(chunking.embedding_input(df.columns).alias("t")).collect()[2]["t"] == "chunk\n"
    assert chunking.split_chunks(df.limit(0)).count() == 0
    assert [r["n"] for r in df.select(chunking.count_tokens(F.col("content")).alias("n")).collect()] == [3, 9, 0]
