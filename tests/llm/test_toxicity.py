import zlib

import numpy as np

from graphloom.llm import queries
from graphloom.llm.toxicity import BAG, score_documents, subwords, train, training_rows, words_of

CLEAN = "the river runs past old stone houses and quiet green fields under bright morning clouds".split()


def made(n, seed):
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for i in range(n):
        words = list(rng.choice(CLEAN, rng.integers(3, 60)))
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = str(rng.choice(["blockhead", "scumbag", "dimwitted"]))
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return texts, np.array(toxic)


def test_words_and_unseen_misspellings():
    scorer = train(*made(400, 1)).scorer()
    texts, toxic = made(200, 2)
    assert ((scorer.logits(texts) >= 0) == toxic).mean() > 0.98
    tell = lambda w: scorer.logits([" ".join([*CLEAN, w, *CLEAN])])[0]
    for word in ("blokhead", "scumbagz", "dimwited"):
        assert tell(word) > max(tell("houses"), tell("meadow"))


def test_long_texts_and_batches():
    scorer = train(*made(300, 3)).scorer()
    texts = [" ".join(CLEAN * 5000), " ".join([*CLEAN * 5000, "scumbag"]), "", "  ", "scumbag"]
    got = scorer.logits(texts)
    assert list(got >= 0) == [False, True, False, False, True]
    assert np.allclose(got, [scorer.logits([t])[0] for t in texts])


def test_one_class():
    assert (train(["a b", "c d"], np.array([0, 0])).scorer().logits(["a b", ""]) < 0).all()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.toxicity_scores(spark, d).collect()
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, d, "labels").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in known]) > 0.9
    assert sorted(queries.toxicity_scores(spark, d).collect()) == sorted(rows)


def test_tricky_rows(spark, tricky):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = train(*training_rows(tricky, labels))
    assert score_documents(tricky, model).count() == tricky.count()
    assert score_documents(tricky.limit(0), model).count() == 0


def test_scores_against_all_bags_one_by_one():
    model = train(*made(300, 4))
    texts, _ = made(60, 5)
    texts += ["", " ", "one", "one two", "scumbag " * 7, " ".join(CLEAN * 40) + " dimwited", "Ünïcödé wörds 日本 and😀signs"]
    got = model.scorer().logits(texts)
    for text, logit in zip(texts, got):
        words, best = words_of(text), None
        if not words:
            assert logit == -4
            continue
        for at in range(max(1, len(words) - BAG + 1)):
            grams = [g for w in words[at : at + BAG] for g in subwords([w])[0].tolist()]
            mean = sum(float(model.ngram[g]) for g in grams) / max(1, len(grams))
            best = mean if best is None else max(best, mean)
        assert abs(logit - (best + model.bias)) < 1e-4


def test_training_rows_are_taken_whole(spark):
    docs = spark.createDataFrame([(i, "word " * (20_000 if i % 3 else 3)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    texts, _ = training_rows(docs, labels)
    assert sorted({len(t) for t in texts}) == [15, 100_000] and len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30))
    fewer, _ = training_rows(docs, labels, max_chars=250_000)
    assert set(fewer) <= set(texts) and 250_000 <= sum(map(len, fewer)) < 350_000
