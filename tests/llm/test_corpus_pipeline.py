import math
import os
import sys

import pytest
from test_best_fit_packing import check as check_packing
from test_jaccard_join import brute as brute_groups
from test_mixing import check as check_mixing
from test_substring_dedup import brute as brute_repeats

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from graphloom.llm import toxicity  # noqa: E402
from graphloom.llm.mixing import mix  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{D}/documents.parquet")
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[1:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS


def test_toxicity(spark, stages):
    docs, kept = stages[0], stages[1]
    model = toxicity.train(*toxicity.training_rows(docs, spark.read.parquet(f"{D}/labels.parquet")))
    scorer = model.scorer()
    want = {r["doc_id"] for r in docs.collect() if scorer.logits([r["text"] or ""])[0] < 0}
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < docs.count()


def test_near_duplicates(stages):
    groups = brute_groups(stages[1].collect(), 80, 100, 5)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({c for _, _, c in groups})


def test_passages(stages):
    _, texts = brute_repeats(stages[2].collect(), 50)
    assert sorted((r["doc_id"], r["text"]) for r in stages[3].collect()) == sorted(texts)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mixing(stages):
    rows = mix(stages[3]).collect()
    check_mixing(rows, stages[3].collect())
    times = {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["size"]}
    seen = {}
    for r in stages[4].collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: n for i, n in times.items() if n}


def test_packing(stages):
    texts = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    used, least = check_packing(stages[5].collect(), texts)
    assert used <= least + max(2, math.ceil(least / 50))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, D).count() == stages[5].count()


def test_tricky_rows(spark, tricky, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (tricky, tricky.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{i}-{docs is tricky}-{id(docs)}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
