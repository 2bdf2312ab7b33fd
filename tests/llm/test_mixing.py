import re
from collections import defaultdict

import pytest

from graphloom.llm import queries
from graphloom.llm.mixing import mix, source_targets


def brute_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def check(rows, df_rows, key=lambda r: r["doc_id"]):
    sizes = defaultdict(int)
    for r in df_rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    targets = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken, biggest = defaultdict(int), defaultdict(int)
    source = {(r["doc_id"], r["text"]): r["source"] for r in df_rows}
    by_id = defaultdict(list)
    for r in df_rows:
        by_id[r["doc_id"]].append(r["source"])
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(targets[s])
        assert r["size"] * int(targets[s] / max(1, sizes[s]) + 1e-12) <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= biggest[s] + 1
    assert source


def test_on_the_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    rows = mix(docs).collect()
    check(rows, docs.collect())
    again = queries.mixing_targets(spark, d).collect()
    assert sorted(again) == sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows)


def test_tricky_rows(spark, tricky):
    out = mix(tricky)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "size", "source_size", "target", "taken"]
    rows = out.collect()
    assert len(rows) == tricky.count()
    check(rows, tricky.collect())


def test_empty(spark, tricky):
    assert mix(tricky.limit(0)).count() == 0


def test_caps_below_the_share(spark):
    s = spark.createDataFrame([("a", 1.0, 10), ("b", 3.0, 0)], "source string, weight double, size long")
    got = {r["source"]: r["target"] for r in source_targets(s, 5.0, 2.0).collect()}
    assert got == {"a": 20.0, "b": 0.0}
