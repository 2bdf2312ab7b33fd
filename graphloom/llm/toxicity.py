"""Toxicity: subword-bag embeddings averaged into a linear softmax, embeddings and softmax trained jointly in numpy.

A bag is a few neighbouring words; its vector is the mean of the vectors of the words' character n-grams, hashed into a
fixed table. A misspelling shares most n-grams, and so vectors, with the word it comes from. Documents are labelled as
wholes, but a single bag makes a document toxic: a document's score is that of its most toxic bag, and training
alternates between choosing each toxic document's bag and fitting, with the worst bags of clean documents against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import byte_slices, makes_room

BUCKETS = 1 << 17
NGRAMS = (3, 4, 5, 6)
BAG = 3
_EDGES = b".,;:!?\"'()[]{}-"


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``<word>`` for all words, one after the other, and where each word's begin (one more at the end)."""
    framed = [b"<" + (w.strip(_EDGES) or w) + b">" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(framed)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)  # bytes to the word's end
    hashes, owners = [], []
    rolling = np.zeros(len(flat), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        span = len(flat) - n + 1
        if span <= 0:
            break
        rolling = rolling[:span] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            ok = left[:span] >= n
            h = rolling[ok]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append(((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[:span][ok])
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(words)))])


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


@dataclass(frozen=True)
class SubwordModel:
    """The trained model as each n-gram's share of the difference of the two logits, and their bias."""

    ngram: np.ndarray
    bias: float

    def scorer(self, memo_size: int = 300_000) -> BagScorer:
        return BagScorer(self, memo_size)


class BagScorer:
    """Scores whole texts; each distinct word's n-grams are summed once, in a memo of bounded size."""

    def __init__(self, model: SubwordModel, memo_size: int):
        self.model, self.memo_size = model, memo_size
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.total, self.count = np.zeros(0), np.zeros(0)

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 20_000):  # in steps, to bound memory
            self._add(new[i : i + 20_000])

    def _add(self, words: list[bytes]) -> None:
        ids, begin = subwords(words)
        total = np.concatenate([[0.0], np.cumsum(self.model.ngram[ids].astype(np.float64))])
        at = len(self.total)
        self.total = np.concatenate([self.total, total[begin[1:]] - total[begin[:-1]]])
        self.count = np.concatenate([self.count, np.diff(begin).astype(np.float64)])
        self.memo.update(zip(words, range(at, at + len(words))))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The logit of each text's most toxic bag; a text without words has a low one."""
        if len(self.memo) > self.memo_size:
            self._forget()
        split = [words_of(t) for t in texts]
        known = set().union(*split) if split else set()
        if new := [w for w in known if w not in self.memo]:
            self._learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        out = np.where(sizes > 0, self.model.bias, min(self.model.bias, -4.0))
        if not sizes.sum():
            return out
        place = self.memo.__getitem__
        at = np.concatenate([np.fromiter(map(place, words), np.int64, len(words)) for words in split if words])
        total, count = (np.concatenate([[0.0], np.cumsum(x[at])]) for x in (self.total, self.count))
        owner = np.repeat(np.arange(len(texts)), sizes)
        end = np.cumsum(sizes)
        start = np.arange(len(at))
        stop = np.minimum(start + BAG, end[owner])
        whole = (start + BAG <= end[owner]) | (start == (end - sizes)[owner])  # full bags, or all there is
        mean = (total[stop] - total[start]) / np.maximum(1.0, count[stop] - count[start])
        mean[~whole] = -np.inf
        full = sizes > 0
        out[full] += np.maximum.reduceat(mean, (end - sizes)[full])
        return out


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram ids of all distinct words with their bounds, the words (as numbers) of every bag, and the bag's text."""
    number: dict[bytes, int] = {}
    bags, owner = [], []
    for i, text in enumerate(texts):
        words = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
        if not len(words):
            continue
        starts = np.arange(max(1, len(words) - BAG + 1))
        padded = np.concatenate([words, np.full(BAG, -1, np.int32)])
        bags.append(padded[starts[:, None] + np.arange(BAG)])
        owner.append(np.full(len(starts), i, np.int32))
    words = list(number)
    parts = [subwords(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]  # in steps, to bound memory
    begin = np.cumsum(np.concatenate([[0], *(np.diff(b) for _, b in parts)]))
    return np.concatenate([g for g, _ in parts] or [np.zeros(0, np.int32)]), begin, np.concatenate(bags or [np.zeros((0, BAG), np.int32)]), np.concatenate(owner or [np.zeros(0, np.int32)])


def train(texts: list[str], toxic: np.ndarray, dim: int = 8, rounds: int = 4, rate: float = 0.6, first_bags: int = 150_000, seed: int = 5) -> SubwordModel:
    """Fits n-gram vectors and the two-class softmax together by Adagrad, in ``rounds`` of choosing each text's worst bags
    from all of its bags and fitting those. The fit before the first choice draws ``first_bags`` bags of all texts."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    softmax = np.stack([-np.ones(dim), np.ones(dim)]).astype(np.float32) / np.sqrt(dim)
    bias = np.zeros(2, np.float32)
    toxic = np.asarray(toxic).astype(np.int64)
    if not len(texts) or len(set(toxic.tolist())) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), -10.0 if not toxic.any() else 10.0)
    ids, begin, bags, owner = _bags(texts)
    if not len(ids):
        return SubwordModel(np.zeros(BUCKETS, np.float32), -10.0)
    label = toxic.astype(np.int8)[owner]
    squares = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, softmax, bias)]

    def ngrams(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the bags at rows: n-gram ids, the bag each belongs to, and 1 over each bag's number of n-grams."""
        words = bags[rows]
        at, which = np.nonzero(words >= 0)
        w = words[at, which]
        n = begin[w + 1] - begin[w]
        first = np.repeat(begin[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        inside = np.repeat(at, n)
        return ids[first + np.arange(len(first))], inside, 1.0 / np.maximum(1, np.bincount(inside, minlength=len(rows)))

    def means(rows: np.ndarray):
        g, inside, share = ngrams(rows)
        mean = np.stack([np.bincount(inside, vectors[g, d], len(rows)) for d in range(dim)], 1) * share[:, None]
        return g, inside, share, mean.astype(np.float32)

    def fit(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, step: float) -> None:
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for part in np.array_split(order, max(1, len(order) // 4096)):
                g, inside, share, mean = means(rows[part])
                logit = mean @ softmax.T + bias
                logit -= logit.max(1, keepdims=True)
                p = np.exp(logit)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), target[part].astype(np.int64)] -= 1
                p *= weight[part][:, None]
                back = (p @ softmax) * share[:, None]
                used, place = np.unique(g, return_inverse=True)
                grads = np.stack([np.bincount(place, back[inside, d], len(used)) for d in range(dim)], 1).astype(np.float32)
                squares[0][used] += grads**2
                vectors[used] -= step * grads / np.sqrt(squares[0][used])
                for k, (x, grad) in enumerate(((softmax, p.T @ mean), (bias, p.sum(0))), 1):
                    squares[k] += grad**2
                    x -= 0.1 * step * grad / np.sqrt(squares[k])

    def model() -> SubwordModel:
        return SubwordModel((vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))

    # all bags of toxic documents count as slightly toxic at first: n-grams that clean documents never have stand out
    some = np.sort(rng.choice(len(owner), min(len(owner), first_bags), replace=False))
    balance = np.where(label[some] == 1, 0.5 / max(1, (label[some] == 1).sum()), 0.5 / max(1, (label[some] == 0).sum())) * len(some)
    fit(some, label[some], balance.astype(np.float32), 2, rate / 3)
    for _ in range(rounds):
        now = model()
        per_word = np.append(np.add.reduceat(now.ngram[ids], begin[:-1]), np.float32(0))  # a word has one n-gram at least
        n_word = np.append(np.diff(begin), 0)
        score = (sum(per_word[b] for b in bags.T) / np.maximum(1, sum(n_word[b] for b in bags.T))).astype(np.float32)
        order = np.lexsort((-score, owner))
        fresh = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1])
        sizes = np.diff(np.append(fresh, len(order)))
        worst = np.concatenate([order[fresh[sizes > k] + k] for k in range(4)])
        is_first = np.concatenate([np.full((sizes > k).sum(), k == 0) for k in range(4)])
        rows = np.sort(worst[(label[worst] == 0) | is_first])
        weight = np.where(label[rows] == 1, 1.0 / max(1, (label[rows] == 1).sum()), 1.0 / max(1, (label[rows] == 0).sum()))
        fit(rows, label[rows], (weight * len(rows) / 2).astype(np.float32), 3, rate)
    fitted = model()
    scorer = fitted.scorer(50_000)
    logits = np.concatenate([scorer.logits(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    return SubwordModel(fitted.ngram, fitted.bias - _cut(logits, toxic))


def _cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The logit that parts the classes with the fewest errors, in the middle of its gap."""
    order = np.argsort(logits)
    x, y = logits[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[(1 - y).sum()], (1 - y).sum() - np.cumsum(1 - y)])
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    gaps = edges[best + 1] - edges[best]
    k = best[int(np.argmax(gaps))]
    return float((edges[k] + edges[k + 1]) / 2)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0 (also for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int = 5_000, max_chars: int = 30_000_000) -> tuple[list[str], np.ndarray]:
    """Labelled texts that aren't held out, in the order of a hash of their id: ``max_rows`` at most, and no more after
    ``max_chars`` characters in all.

    The two bounds are the training sample's, in rows taken whole whatever their length, and hold at every size of
    input; scoring reads whole texts of all rows. An id with several labels counts as toxic if one of them says so; null labels don't count.
    """
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", "text").filter(F.length("text") >= 1).join(F.broadcast(ids), "doc_id")  # max_rows rows
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic", F.length("r.text").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = one.select("doc_id", F.coalesce(before, F.lit(0)).alias("before"), "n").filter(F.col("before") < max_chars).select("doc_id")
    table = one.select("doc_id", "text", "toxic").join(kept, "doc_id").toArrow().sort_by("doc_id")
    return table.column("text").to_pylist(), np.array(table.column("toxic").to_pylist(), np.int64)


def score_documents(documents: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: id, the columns in keep, score (0 to 1) and predicted (score >= 0.5).

    A null, empty or blank text has the score of a bag without n-grams, which is low. Very long texts are scored whole.
    Repeated rows stay, other columns are not read, an empty table gives an empty one. The model has a fixed size.
    """
    names = [id_col, *[c for c in keep if c != id_col]]
    source = documents.select(*[documents[c].alias(f"c{i}") for i, c in enumerate(names)], documents[text_col].alias("t"))
    shared = documents.sparkSession.sparkContext.broadcast((model.ngram, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room()
        scorer = SubwordModel(*shared.value).scorer()
        for whole in batches:
            for batch in byte_slices(whole, "t", slice_bytes):
                logits = scorer.logits([t or "" for t in batch.column("t").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*names, "score", "predicted"],
                )

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[f'c{i}']}" for i, c in enumerate(names)) + ", score double, predicted int")
