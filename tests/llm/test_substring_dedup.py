import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from graphloom.llm import queries
from graphloom.llm.substring_dedup import remove_repeats, without_repeats


def brute(rows, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    often = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out, texts = [], []
    for r, w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if often[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r["doc_id"], len(w), len(gone), sha256(kept.encode()).hexdigest()))
        texts.append((r["doc_id"], kept if gone else r["text"]))
    return out, texts


def same(df, size):
    rows = df.collect()
    want, texts = brute(rows, size)
    order = lambda x: sorted(x, key=repr)
    assert order(map(tuple, remove_repeats(df, size).collect())) == order(want)
    out = without_repeats(df, size)
    assert out.columns == df.columns
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order(texts)


def test_on_the_documents(spark):
    same(queries.table(spark, "/root/testdata/sf0.001", "documents"), 35)


def test_at_the_larger_size(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    want, _ = brute(docs.collect(), 35)
    got = sorted(map(tuple, queries.repeated_passages(spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(want) and sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("size,seed", [(4, 1), (5, 2), (7, 3), (9, 4), (12, 5)])
def test_small_alphabets(spark, size, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(120)]
    same(spark.createDataFrame(rows, "doc_id long, text string"), size)


def test_tricky_rows(spark, tricky):
    same(tricky, 35)
    same(tricky, 5)
    assert remove_repeats(tricky.limit(0)).count() == 0 and without_repeats(tricky.limit(0)).count() == 0
