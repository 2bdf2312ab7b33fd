"""URL filters: glob rules packed into multiword Shift-And masks and simulated together over each canonical URL.

All rules become one bit vector: bit j of a rule is on after its first j+1 literals have been read. One step over a
byte is ``((state << 1) & ~first | entry) & accepts[byte] | state & loops``; a ``*`` after a literal is a loop on that
literal's bit, a leading ``*`` re-enters the rule at every byte. URLs advance in lockstep as a numpy matrix of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Stands between host and path in a canonical URL; no UTF-8 text has this byte.
BOUND = b"\xff"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and the paths that start with ``path`` (``*``, ``?`` are globs)."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> bytes:
        return b"*." + self.host.encode() + BOUND + self.path.encode() + b"*"


@dataclass(frozen=True)
class Glob:
    """Globs of a host with a dot in front and of a path, which both must fit whole."""

    host: str
    path: str = "*"

    @property
    def glob(self) -> bytes:
        return self.host.encode() + BOUND + self.path.encode()


class GlobAutomaton:
    """Glob patterns over bytes (``*``: any run, ``?``: any byte, backslash: next byte is literal), all in one pass."""

    def __init__(self, patterns: Iterable[bytes]):
        self.patterns = list(patterns)
        parsed = [self._parse(p) for p in self.patterns]
        total = sum(len(literals) for literals, _, _ in parsed)
        self.words = max(1, -(-total // 64))
        accepts, first, entry, start, loops = (np.zeros((n, self.words), np.uint64) for n in (256, 1, 1, 1, 1))
        self.last: list[int | None] = []
        self.empty: list[bool] = []
        at = 0
        for literals, stars, lead in parsed:
            self.empty.append(lead)
            for j, literal in enumerate(literals):
                word, bit = divmod(at + j, 64)
                mask = np.uint64(1 << bit)
                if literal is None:
                    accepts[:, word] |= mask
                else:
                    accepts[literal, word] |= mask
                if j == 0:
                    first[0, word] |= mask
                    start[0, word] |= mask
                    if lead:
                        entry[0, word] |= mask
                if stars[j]:
                    loops[0, word] |= mask
            at += len(literals)
            self.last.append(at - 1 if literals else None)
        self.accepts, self.not_first, self.entry, self.start, self.loops = accepts, ~first, entry, start, loops

    @staticmethod
    def _parse(pattern: bytes) -> tuple[list[int | None], list[bool], bool]:
        literals: list[int | None] = []
        stars: list[bool] = []
        lead, quoted = False, False
        for c in pattern:
            if c == 0x2A and not quoted:
                if stars:
                    stars[-1] = True
                else:
                    lead = True
                continue
            if c == 0x5C and not quoted:
                quoted = True
                continue
            literals.append(None if c == 0x3F and not quoted else c)
            stars.append(False)
            quoted = False
        return literals, stars, lead

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: does pattern j (column) fit the whole of text i (row)?"""
        n = len(texts)
        out = np.zeros((n, len(self.patterns)), bool)
        if not n:
            return out
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = np.zeros((n, self.words), np.uint64)
        one, carry = np.uint64(1), np.uint64(63)
        # sizes fall, so the texts that have a byte at this position are the first ``live`` ones
        for at in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            now = state[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> carry
            moved &= self.not_first
            moved |= self.start if at == 0 else self.entry
            moved &= self.accepts[flat[begin[:live] + at]]
            moved |= now & self.loops
            state[:live] = moved
        for j, last in enumerate(self.last):
            if last is None:
                out[order, j] = True if self.empty[j] else sizes == 0
            else:
                word, bit = divmod(last, 64)
                out[order, j] = (state[:, word] >> np.uint64(bit)) & one > 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def judge_urls(pages: DataFrame, rules: list[Rule], blocked: list[Glob] = [], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the text of the longest rule that fits (null if none) and a verdict: the rule's, else
    ``block`` if one of the globs fits, else ``default``. Rules and globs are simulated together.

    Null urls and urls without ``://`` have an empty host and path, judged like others. Rules of the same length: the
    one listed last. Repeated rows stay, other columns are not read, an empty table gives an empty one.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -i))
    automaton = GlobAutomaton([*(rules[i].glob for i in ranked), *(b.glob for b in blocked)])
    texts = [rules[i].text for i in ranked]
    verdicts = [rules[i].verdict for i in ranked]
    source = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [canonical(u) for u in batch.column("url").to_pylist()]
            fits = automaton.fits([b"." + h.encode() + BOUND + p.encode() for h, p in parts])
            of_rules, bad = fits[:, : len(texts)], fits[:, len(texts) :].any(axis=1).tolist()
            best = np.where(of_rules.any(axis=1), of_rules.argmax(axis=1), -1).tolist() if texts else [-1] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([texts[b] if b >= 0 else None for b in best], pa.string()),
                    pa.array([verdicts[b] if b >= 0 else "block" if no else default for b, no in zip(best, bad)], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
