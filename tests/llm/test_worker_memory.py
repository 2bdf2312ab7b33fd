"""A Python worker goes from operator to operator; what one remembers must not add up with what the next one takes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.llm import best_fit_packing, jaccard_join, substring_dedup, toxicity
from graphloom.llm.word_hashes import WORDS

TEXTS = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["one two three four five six", None]})


class Caught:
    """Gives what an operator would run in a worker."""

    def mapInArrow(self, run, kinds):
        return run


def test_only_the_operator_at_work_remembers():
    for run in (substring_dedup._read(Caught(), 4, 1), jaccard_join._read(Caught(), jaccard_join.Likeness(80, 100, 5))):
        best_fit_packing._tokens["a tokenizer"] = None
        assert sum(b.num_rows for b in run(iter([TEXTS]))) == 2
        assert not best_fit_packing._tokens and len(WORDS) >= 6
    best_fit_packing._tokens["a tokenizer"] = None
    assert not list(best_fit_packing._epoch(Caught(), 8, 0)(iter([])))
    assert not best_fit_packing._tokens and not WORDS


def test_many_new_words_are_learned_in_steps():
    words = [b"word%d" % i for i in range(100_000)]
    ngram = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    scorer = toxicity.SubwordModel(ngram, 0.0).scorer()
    tracemalloc.start()
    scorer._learn(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    for i in (0, 19_999, 20_000, 99_999):
        ids, _ = toxicity.subwords([words[i]])
        at = scorer.memo[words[i]]
        assert abs(scorer.total[at] - ngram[ids].sum(dtype=np.float64)) < 1e-6 and scorer.count[at] == len(ids)
