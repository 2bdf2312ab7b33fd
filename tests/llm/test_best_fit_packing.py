import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from graphloom.llm import queries
from graphloom.llm.best_fit_packing import ChunkTokens, best_fit, crossover, evolve, gathered, islands_of, longest_first, mutate, pack, pack_documents, settled

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)


def check(rows, texts, size=2048):
    got, wanted, places = [], [], defaultdict(list)
    for r in rows:
        got.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts:
        ids = [*MODEL.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            wanted.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    order = lambda x: sorted(x, key=repr)
    assert order(got) == order(wanted)
    total = 0
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
        total += at
    return len(places), -(-total // size)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in queries.table(spark, d, "documents").collect()]
    used, least = check(queries.packed_sequences(spark, d).collect(), texts)
    assert used <= least + max(2, least // 50)


def test_tricky_rows(spark, tricky):
    texts = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    check(pack_documents(tricky, PATH, 64).collect(), texts, 64)
    assert pack_documents(tricky.limit(0), PATH).count() == 0


def test_many_shards(spark):
    pieces = spark.range(5000).selectExpr("id doc_id", "cast(pmod(xxhash64(id), 90) + 1 as bigint) length", "'x' sequence_id")
    rows = pack(pieces, size=100, shard_pieces=300).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert len(rows) == 5000 and max(fill.values()) <= 100
    assert len(fill) <= 1.06 * sum(fill.values()) / 100


def test_chunks_are_exact():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "Th", " ", "\n", "é", "é", "́", "日", "<|endoftext|>", "'s", "7", ".", "\t", " ", "\x1c", "Σ", "!!", "İ"]) for _ in range(rng.randrange(25))) for _ in range(3000)]
    tokens = ChunkTokens(PATH, memo_size=100)
    assert tokens.cuts
    got = [ids for i in range(0, len(texts), 50) for ids in tokens.of([t.encode() for t in texts[i : i + 50]])]
    assert got == [np.array(MODEL.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def exact(texts, tokens):
    assert tokens.of([t.encode() for t in texts]) == [np.array(MODEL.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, model):
        self.model, self.given = model, 0

    def encode_batch_fast(self, texts, **how):
        self.given += sum(map(len, texts))
        return self.model.encode_batch_fast(texts, **how)

    encode_batch = encode_batch_fast


def test_new_words_go_to_the_bare_model():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopéüß") for _ in range(12))
    texts = [" ".join(w for _ in range(10) for w in (word(), word().upper().replace("SS", "s") + ",", word().capitalize() + ".$$$")) for _ in range(100)]
    tokens = ChunkTokens(PATH)
    tokens.model = whole = Counted(tokens.model)
    exact(texts, tokens)
    assert whole.given < sum(map(len, texts)) / 20


def test_letters_that_normalizing_changes():
    """Composed, decomposed, replaced and context-dependent letters, signs and digits, next to letters and marks."""
    rng = random.Random(7)
    parts = ["a", "B", "é", "É", "e\u0301", "Σ", "σ", "ς", "İ", "ß", "ẞ", "ǅ", "ﬁ", "\u212a", "\u212b", "\u1100", "\u1161", "\uac00", "\u11a8", "क", "\u093c", "\u0958", "ไ", "日", "Ⅷ", "²", "٣", "7", "ª", "'", "'s", "’", "$$$", ",", ".", "<", "|", "<|endoftext|>", "<|x", "\x1c", "\x7f", "\0", "\x85", "\xa0", "\u2028", "\u200d", "😀"]
    tokens = ChunkTokens(PATH, memo_size=1000)
    for _ in range(20):
        exact(["".join(rng.choice([*parts, " "]) for _ in range(rng.randrange(12))) for _ in range(300)], tokens)
    exact(["", " ", "x" * 5000 + "!" * 300, "é" * 400, "x" * 5000], tokens)
    assert tokens.of([]) == [] and tokens.of([b""]) == [b""]


def test_small_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i]), "text": pa.array(["x" * (i % 7)])}) for i in range(1000)]
    for least in (0, 100, 1 << 20):
        got = list(gathered(iter(batches), least))
        assert [x for b in got for x in b.column("id").to_pylist()] == list(range(1000))
        assert len(got) == {0: 1000, 1 << 20: 1}.get(least, len(got)) and all(b.nbytes <= least for b in got if least)
    assert list(gathered(iter([]), 100)) == []


def test_operators_keep_every_item():
    rng = random.Random(3)
    for seed in range(30):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 120))]
        everything = list(range(len(lengths)))
        a, b = (best_fit(lengths, rng.sample(everything, len(everything)), 100) for _ in "ab")
        for p in (a, b, crossover(lengths, a, b, 100, rng), mutate(lengths, a, 100, rng), *evolve(lengths, 100, seed, [a])[0]):
            assert sorted(x for y in p.bins for x in y) == everything
            assert [sum(lengths[x] for x in y) for y in p.bins] == p.fills and all(0 < f <= 100 for f in p.fills)
        assert len(evolve(lengths, 100, seed, [a])[0][0].bins) <= len(a.bins)


def fewest(lengths, size):
    """The least number of bins, by trying every bin for every item."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for j, f in enumerate(fills):
            if f + lengths[i] <= size:
                place(i + 1, [*fills[:j], f + lengths[i], *fills[j + 1 :]])
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def test_as_few_bins_as_possible():
    rng = random.Random(4)
    for seed in range(40):
        lengths = sorted((rng.randrange(5, 70) for _ in range(rng.randrange(1, 10))), reverse=True)
        elites, _ = evolve(lengths, 100, seed, [])
        assert len(settled(lengths, 100, elites[0]).bins) == fewest(lengths, 100)


def test_generations_and_migration_do_the_packing(spark):
    """Islands begin with more bins than the decreasing order needs and end, by crossover and migration, with no more."""
    rng = random.Random(5)
    lengths = sorted((min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(3000)), reverse=True)
    plain = len(best_fit(lengths, longest_first(lengths, list(range(3000))), 2048).bins)
    whole = spark.createDataFrame([(0, lengths), (1, lengths)], "shard long, lengths array<int>")
    for shard in (0, 1):
        alone = evolve(lengths, 2048, shard * 64 * 16, [])
        assert alone[1] > plain and len(alone[0][0].bins) < alone[1]
    last = islands_of(whole, 2048, 2, 3, 3).groupBy("shard").agg({"bins": "min"}).collect()
    assert all(r["min(bins)"] <= plain for r in last)
