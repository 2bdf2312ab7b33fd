"""Stable 64-bit hashes of words and of runs of words, as numpy arrays over many texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from graphloom.llm.shared import memo

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


class WordHashes(dict):
    """Hash of each word (UTF-8 bytes), remembered for the last few hundred thousand distinct words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One memo a process, whichever operators run in it.
WORDS = WordHashes()
memo("words", WORDS.clear)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each salt."""
    x = x + np.uint64((salt * _STEP + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of words: ``at(start, size)`` for arrays of starts and sizes, equal for equal runs anywhere."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if len(Runs._up) < n:
            Runs._up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n * 5 // 4, _STEP, np.uint64)]))
            Runs._down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n * 5 // 4, _BACK, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * Runs._down[: n - 1], dtype=np.uint64)])

    def at(self, start: np.ndarray, size, salt: int = 0) -> np.ndarray:
        stop = start + size
        raw = (self.sums[stop] - self.sums[start]) * Runs._up[stop - 1]
        return mixed(raw, salt).view(np.int64)
