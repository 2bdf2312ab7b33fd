"""Small fixtures with known answers for operators of the library."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.vectors import cosine, hash_embedding, unit
from graphloom.operators import changes, retrieval, symbols, traversal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fnv_and_tokens(spark):
    assert one(spark, T.fnv1a(F.lit("hello"))) == 1335831723
    assert one(spark, T.tokens(F.lit("getUserName from_db(X9)"))) == ["get", "user", "name", "from_db", "x9"]
    assert one(spark, T.camel_grams(F.array(F.lit("red"), F.lit("ring"), F.lit("box")), 2)) == ["redRing", "ringBox"]
    assert one(spark, T.role_names(F.lit(0))) == ["ReadAccess"] and one(spark, T.role_names(F.lit(34))) == ["Import", "Test"]


def test_truncation_keeps_characters_whole(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé日😀") for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.truncate_utf8(F.col("t"), 40).alias("x")).collect():
        raw, suffix = row["t"].encode(), "\n[truncated]"
        if len(raw) <= 40:
            assert row["x"] == row["t"]
        else:
            assert row["x"] == raw[: 40 - len(suffix)].decode(errors="ignore") + suffix


@pytest.mark.parametrize("pattern,path,fits", [("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src", "src/a/b.ts", True), ("a?c.ts", "abc.ts", True), ("a.c", "abc", False)])
def test_globs(pattern, path, fits):
    import re

    assert bool(re.match(T.glob_regex(pattern), path)) == fits


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "old"), ("gone", "h")], "path string, h string")
    after = spark.createDataFrame([("a", "1"), ("b", "new"), ("added", "h")], "path string, h string")
    got = {r["path"]: r["status"] for r in changes.snapshot_diff(before, after, "path", "h").collect()}
    assert got == {"a": "unchanged", "b": "changed", "gone": "deleted", "added": "added"}


def test_padded_batches(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([3, 3, 6, 9])], "g string, k int, n int")
    rows = sorted(changes.padded_batches(df, "g", "k", "n", 10, 8, 18).collect(), key=lambda r: r["k"])
    assert [r["batch"] for r in rows] == [0, 0, 1, 2]


def test_greedy_bins_start_anew(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 5, 1, 9, 2])], "g string, k int, n int")
    rows = sorted(changes.greedy_bins(df, "g", "k", "n", 10, 2).collect(), key=lambda r: r["k"])
    assert [r["bin"] for r in rows] == [0, 0, 1, 1, 2]


def test_transitive_calls(spark):
    e = spark.createDataFrame([("s", "m", "high"), ("s", "m", "low"), ("m", "l", "high"), ("m", "r", "medium"), ("s", "r", "high"), ("m", "s", "high")], "from_id string, to_id string, confidence string")
    rows = [tuple(r) for r in traversal.two_hop_calls(e).collect()]
    assert rows == [("s", "m", "l", "high")]
    assert traversal.two_hop_calls(e, cap=0).count() == 0


def test_best_first_agrees_with_all_paths_on_trees(spark):
    tree = [(i, j, 10 + j % 3) for i in range(15) for j in (2 * i + 1, 2 * i + 2)]
    edges = spark.createDataFrame(tree, "from_id long, to_id long, weight long")
    pairs = spark.createDataFrame([(0, 17), (0, 5), (1, 22), (3, 3), (2, 1)], "start long, goal long")
    got = sorted((r["start"], r["goal"], r["hops"], r["score"], r["path"]) for r in traversal.best_first(edges, pairs, 4).collect())
    want = sorted((r["start"], r["goal"], r["hops"], r["score"], r["path"]) for r in traversal.best_paths(edges, pairs, 4).collect())
    assert got == want and [g[:2] for g in got] == [(0, 5), (0, 17), (1, 22)]


def test_expand_keeps_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "from_id long, to_id long")
    got = {r["id"]: r["depth"] for r in traversal.expand(edges, spark.createDataFrame([(1,)], "id long"), 2, False).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_interleaving(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["a", "b", "c"], ["b", "d"]))
    assert [r["id"] for r in symbols.interleaved([a, b], ["id"], 4).collect()] == ["a", "b", "d", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in hash_embedding(df, "id", "t").collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-12 and rows[2] == rows[3] == [0.0] * 64
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, unit(v)) == [0.6, 0.8] and one(spark, cosine(v, v)) == pytest.approx(1)


def test_query_model():
    m = retrieval.query_model("where is getUser called from the route")
    assert m.intent == "caller" or m.intent == "app-flow"
    assert "getUser" in m.code_tokens and "route" in m.symbol_tokens and "from" not in m.symbol_tokens
    assert retrieval.query_model("").intent == "broad"


def test_dangling(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b")], "from_id string, to_id string")
    assert sorted(tuple(r) for r in symbols.dangling(edges, nodes).collect()) == [("a", "x"), ("y", "b")]
