import public_tokenizers
import sentencepiece

from graphloom.llm import queries
from graphloom.llm.token_counts import PieceCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def whole(texts):
    return list(map(len, sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)))


def test_tricky_rows(spark, tricky):
    source = sorted((t or "" for t in (r["text"] for r in tricky.collect())))
    rows = token_counts(tricky, MODEL, slice_bytes=100).collect()
    want = {t: n for t, n in zip(source, whole(source))}
    assert sorted(r["n_tokens"] for r in rows) == sorted(want[t] for t in source)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len(t.encode()) for t in source)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def test_split_is_exact():
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "th", " ", "  ", "\n", "é", "▁", "日", "<s>", ".", "\t", " The"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    counter = PieceCounter(MODEL, memo_size=50, batch_bytes=64)
    assert counter.splits
    got = []
    for i in range(0, len(texts), 100):
        got += counter.lengths(texts[i : i + 100])
    assert got == whole(texts)


def test_on_the_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, d, "documents").collect()}
    rows = queries.piece_counts(spark, d).collect()
    want = dict(zip(texts, whole(list(texts.values()))))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert token_counts(queries.table(spark, d, "documents").limit(0), MODEL).count() == 0
