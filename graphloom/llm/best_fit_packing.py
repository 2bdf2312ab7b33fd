"""Best-fit packing of tokenized documents by a grouping genetic algorithm on distributed islands.

Pieces are dealt at random into shards of a few thousand, so that a shard's last, partly filled sequence hardly counts.
Every shard lives on several islands. An island's population starts from pieces best-fitted in random order. Crossover
injects whole well-filled bins of one parent into the other, removes the other's bins that hold one of their pieces,
and best-fits what that displaced; mutation dissolves bins with free space. Between epochs islands of a shard pass
their elites on in a ring. The best packing of a shard's islands is its result; only should the decreasing order,
best-fitted once, need fewer bins does that one stand instead (``settled``).
"""

from __future__ import annotations

import math
import os
import random
import string
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import byte_slices, discard, makes_room, memo, texts_of, written


#: ASCII marks, which may follow a word in any number.
_MARKS = string.punctuation

#: Bytes of text that are cut into words at once: each distinct word among them is handled once.
_SLICE = 4 << 20


class ChunkTokens:
    """Token ids (little-endian unsigned 32-bit) of whole texts, by a tokenizers file.

    A text is cut at ASCII white space, which the tokenizer must treat as nothing but a boundary; ``cuts`` tells whether
    it does, by trial. If case and marks after a word make no difference to the word (``plain``, by trial too), chunks
    are reduced to words. Each distinct word is encoded once while the bounded memo remembers it, words of letters many
    in one call: a token that ends a word tells where each word's ids end. Words of letters that normalizing leaves as
    they are but for their case (``sure``, by trial of each letter) go to the model without normalizer and patterns.
    """

    def __init__(self, path: str, memo_size: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.model.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo_size = memo_size
        self._forget()
        probe = "a b\n c\t\td  \r\n e.f"
        whole = self._ids([probe])[0]
        self.cuts = b"".join(self._ids(probe.split())) == whole and whole == self._ids([" \n" + probe + "\t "])[0]
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(self.model.get_vocab_size())])
        words = ["Word", "ÉCOLE", "naïve", "a", "x7", "日本"]
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.plain = (
            self.cuts
            and all("<|" in t for t in special)
            and all(b"".join(self._ids([w.encode().lower().decode(), m])) == self._ids([w + m])[0] for w in words for m in (_MARKS, *_MARKS))
            and self._joined(words, self.model).to_pylist() == self._ids(words)
        )
        self.tried: set[str] = set()
        self.sure: set[str] = set()
        self._try(string.ascii_letters)

    def _forget(self) -> None:
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _ids(self, texts: list[str], model=None) -> list[bytes]:
        model = model or self.model
        encode = getattr(model, "encode_batch_fast", model.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], model) -> pa.LargeBinaryArray:
        """Ids of words of letters, from one encoding of all of them."""
        encode = getattr(model, "encode_batch_fast", model.encode_batch)
        ids = np.array(encode([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stop) != len(words):
            return pa.array(self._ids(words), pa.large_binary())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.append(0, stop)), pa.py_buffer(ids)])

    def _try(self, letters: Iterable[str]) -> None:
        """Adds to ``sure`` what the bare model, given small letters, encodes like the whole tokenizer."""
        for c in letters:
            near = [c, "a" + c, c + "a", "a" + c + "a"]
            if self.ends.any() and self._ids(near) == self._ids([x.lower() for x in near], self.bare):
                self.sure.add(c)
            self.tried.add(c)

    def _encoded(self, words: list[str]) -> tuple[list[int], list[pa.LargeBinaryArray]]:
        """The words' places in the order of the arrays, and their ids."""
        wide = [w for w in words if not w.isascii() and w.isalpha()]
        self._try(set("".join(wide)) - self.tried)
        sure, letters, others = [], [], []
        for i, w in enumerate(words):
            if not self.plain or not w.isalpha():
                others.append(i)
            elif self.sure.issuperset(w) and is_normalized("NFC", w):
                sure.append(i)
            else:
                letters.append(i)
        ids = []
        for at in range(0, len(sure), 1000):
            ids.append(self._joined([words[i].lower() for i in sure[at : at + 1000]], self.bare))
        for at in range(0, len(letters), 1000):
            ids.append(self._joined([words[i] for i in letters[at : at + 1000]], self.model))
        for at in range(0, len(others), 1000):
            ids.append(pa.array(self._ids([words[i] for i in others[at : at + 1000]]), pa.large_binary()))
        return sure + letters + others, ids

    def _of_words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of words, distinct or not, by way of the memo."""
        found = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(found.dictionary, value_set=self.keys), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = found.dictionary.take(pa.array(new))
            order, ids = self._encoded(fresh.to_numpy(zero_copy_only=False).tolist())
            at[new[order]] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, fresh.take(pa.array(order, pa.int64()))])
            self.values = pa.concat_arrays([self.values, *ids])
        out = self.values.take(pa.array(at)).take(found.indices)
        if len(new):
            if len(self.keys) > self.memo_size:
                self._forget()
            short = pc.less_equal(pc.binary_length(self.keys), 256)  # the memo is bounded in bytes too
            if not pc.all(short).as_py():
                self.keys, self.values = self.keys.filter(short), self.values.filter(short)
        return out

    def _of_chunks(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct chunks, by way of the words and marks they are made of."""
        if not self.plain:
            return self._of_words(chunks)
        words = pc.ascii_rtrim(pc.ascii_lower(chunks), characters=_MARKS)
        last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
        # marks run on from a sign (normalizing may leave one of a letter), and a special token is a whole
        ends = pa.array([not c or normalize("NFC", c).lower()[-1:].isalnum() for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        whole = pc.or_(pc.match_substring(chunks, "<|"), pc.and_not(pc.not_equal(pc.binary_length(words), pc.binary_length(chunks)), ends))
        words = pc.if_else(whole, chunks, words)
        extra = pc.subtract(pc.binary_length(chunks), pc.binary_length(words)).to_numpy()
        marked = np.flatnonzero(extra)
        marks: dict[str, int] = {"": 0}
        mark = np.zeros(len(chunks), np.int64)
        told = chunks.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist()
        mark[marked] = [marks.setdefault(c[-n:], len(marks)) for c, n in zip(told, extra[marked].tolist())]
        of_marks = self._of_words(pa.array(list(marks), pa.large_string()))
        return pc.binary_join_element_wise(self._of_words(words), of_marks.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.cuts:
            return self._ids([t.decode() for t in texts])
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        found = split.values.dictionary_encode()
        ids = self._of_chunks(found.dictionary).take(found.indices)
        _, starts, raw = ids.buffers()
        at = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        return [raw[a:b].to_pybytes() if b > a else b"" for a, b in zip(at, at[1:])]


_tokens: dict[str, ChunkTokens] = {}
memo("tokens", _tokens.clear)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, small batches put together to about ``least`` bytes."""
    kept, total = [], 0
    for batch in batches:
        if kept and total + batch.nbytes > least:
            yield pa.concat_batches(kept)
            kept, total = [], 0
        kept.append(batch)
        total += batch.nbytes
    if kept:
        yield pa.concat_batches(kept)


def token_pieces(df: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. A document is its ids and ``end_id``; longer ones are cut every ``most``.

    A null or empty text is ``end_id`` alone. Null and repeated ids are documents of their own, texts of any length are
    read whole, other columns are not read, an empty table gives an empty one.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="tokens")
        tokens = _tokens.get(tokenizer_path) or _tokens.setdefault(tokenizer_path, ChunkTokens(tokenizer_path))
        for whole in gathered(batches, _SLICE):
            for batch in byte_slices(whole, "text", _SLICE):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(tokens.of(texts_of(batch, "text"))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Packing(NamedTuple):
    """Items by bin, and how full each bin is."""

    bins: list[list[int]]
    fills: list[int]


def best_fit(lengths: list[int], items: list[int], size: int, start: Packing | None = None) -> Packing:
    """``start`` with items, in their order, each put into the fullest bin that has room, or a new one."""
    bins, fills = start or Packing([], [])
    open_: dict[int, list[int]] = {}  # bins by free space; the bits of mask tell which spaces there are
    mask = 0
    for i, f in enumerate(fills):
        if f < size:
            open_.setdefault(size - f, []).append(i)
    for free in open_:
        mask |= 1 << free
    for item in items:
        n = lengths[item]
        above = mask >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            stack = open_[free]
            i = stack.pop()
            if not stack:
                mask ^= 1 << free
            bins[i].append(item)
            fills[i] += n
            free -= n
        else:
            i = len(bins)
            bins.append([item])
            fills.append(n)
            free = size - n
        if free:
            if free in open_:
                open_[free].append(i)
            else:
                open_[free] = [i]
            mask |= 1 << free
    return Packing(bins, fills)


def worth(packing: Packing, size: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones: the mean squared fill is higher if some bins are full and some empty."""
    n = len(packing.fills)
    return -n, sum(f * f for f in packing.fills) / (size * size * max(1, n))


def crossover(lengths: list[int], giver: Packing, taker: Packing, size: int, rng: random.Random) -> Packing:
    """The taker with some of the giver's best-filled bins injected whole, and what that displaced best-fitted again.

    Best-filled are the full ones, or, if fewer than a quarter are full, the fuller half.
    """
    good = [i for i, f in enumerate(giver.fills) if f == size]
    if 4 * len(good) < len(giver.fills):
        good = sorted(range(len(giver.fills)), key=lambda i: -giver.fills[i])[: max(1, len(giver.fills) // 2)]
    chosen = rng.sample(good, max(1, int(len(good) * rng.uniform(0.3, 0.7))))
    taken = {x for i in chosen for x in giver.bins[i]}
    child = Packing([list(giver.bins[i]) for i in chosen], [giver.fills[i] for i in chosen])
    loose: list[int] = []
    for b, f in zip(*taker):
        if taken.isdisjoint(b):
            child.bins.append(list(b))
            child.fills.append(f)
        else:
            loose += [x for x in b if x not in taken]
    return best_fit(lengths, longest_first(lengths, loose), size, child)


def mutate(lengths: list[int], packing: Packing, size: int, rng: random.Random) -> Packing:
    """All bins with free space and a twentieth of the others are dissolved and their pieces best-fitted again."""
    n = len(packing.fills)
    gone = {i for i, f in enumerate(packing.fills) if f < size} | set(rng.sample(range(n), max(1, n // 20)))
    kept = [i for i in range(n) if i not in gone]
    loose = [x for i in gone for x in packing.bins[i]]
    return best_fit(lengths, longest_first(lengths, loose), size, Packing([list(packing.bins[i]) for i in kept], [packing.fills[i] for i in kept]))


def longest_first(lengths: list[int], items: list[int]) -> list[int]:
    return sorted(items, key=lengths.__getitem__, reverse=True)


def evolve(lengths: list[int], size: int, seed: int, immigrants: list[Packing], population: int = 6, generations: int = 40, patience: int = 8) -> tuple[list[Packing], int]:
    """One epoch of one island: its two best packings, and the bins of the best one before the first generation.

    Members that no immigrant provides are pieces best-fitted in random order. It ends early at the lower bound, and
    after ``patience`` generations without fewer bins.
    """
    rng = random.Random(seed)
    people = list(immigrants)
    least = -(-sum(lengths) // size)
    while len(people) < population and not any(len(p.bins) == least for p in people):
        order = list(range(len(lengths)))
        rng.shuffle(order)
        people.append(best_fit(lengths, order, size))
    ranked = sorted(((worth(p, size), k, p) for k, p in enumerate(people)), reverse=True)
    began = best = -ranked[0][0][0]
    since = 0
    for k in range(generations):
        if best == least or len(ranked) < 2 or since == patience:
            break
        a, b = rng.sample(ranked, 2)
        child = crossover(lengths, max(a, b)[2], min(a, b)[2], size, rng)
        child = mutate(lengths, child, size, rng)
        ranked = sorted([*ranked, (worth(child, size), population + k, child)], reverse=True)[:population]
        since = 0 if -ranked[0][0][0] < best else since + 1
        best = -ranked[0][0][0]
    return [p for _, _, p in ranked[:2]], began


def settled(lengths: list[int], size: int, evolved: Packing) -> Packing:
    """The evolved packing, or the decreasing order best-fitted once should that need fewer bins."""
    plain = best_fit(lengths, longest_first(lengths, list(range(len(lengths)))), size)
    return plain if len(plain.bins) < len(evolved.bins) else evolved


def _placed(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for i, b in enumerate(packing.bins):
        for x in b:
            out[x] = i
    return out


def _packing(lengths: list[int], placed: list[int]) -> Packing:
    n = max(placed, default=-1) + 1
    out = Packing([[] for _ in range(n)], [0] * n)
    for x, i in enumerate(placed):
        out.bins[i].append(x)
        out.fills[i] += lengths[x]
    return out


STATE = "shard long, island int, lengths array<int>, elites array<array<int>>, began int, bins int, squares double"


def _epoch(state: DataFrame, size: int, epoch: int) -> DataFrame:
    """state: shard, island, lengths, guests (packings as bin numbers). Returns it with elites, the bins of the best
    packing before (``began``) and after the epoch, and its worth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room()
        for batch in batches:
            elites, began, bins, squares = [], [], [], []
            for shard, island, lengths, guests in zip(*(batch.column(c).to_pylist() for c in ("shard", "island", "lengths", "guests"))):
                best, first = evolve(lengths, size, (shard * 64 + epoch) * 16 + island, [_packing(lengths, g) for g in guests or ()])
                elites.append([_placed(b, len(lengths)) for b in best])
                began.append(first)
                bins.append(len(best[0].bins))
                squares.append(worth(best[0], size)[1])
            kept = [batch.column(c) for c in ("shard", "island", "lengths")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(elites, pa.list_(pa.list_(pa.int32()))), pa.array(began, pa.int32()), pa.array(bins, pa.int32()), pa.array(squares, pa.float64())],
                names=["shard", "island", "lengths", "elites", "began", "bins", "squares"],
            )

    return state.mapInArrow(run, STATE)


def islands_of(whole: DataFrame, size: int, shards: int, islands: int, epochs: int) -> DataFrame:
    """whole (shard, lengths) -> the last epoch's state. Between epochs each island's elite moves to the next one."""
    none = F.array().cast("array<array<int>>")
    tasks = max(1, math.ceil(shards * islands / 8))  # a number of its own, as the state is small and would be one partition
    state = whole.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", none.alias("guests"))
    old = None
    for epoch in range(epochs):
        now = written(_epoch(state.repartition(tasks, "shard", "island"), size, epoch), "pack-epoch")
        if old is not None:
            discard(old)
        old = now
        moved = now.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("came"))
        state = now.join(moved, ["shard", "island"]).select("shard", "island", "lengths", F.concat("elites", "came").alias("guests"))
    return old


def pack(pieces: DataFrame, size: int = 2048, shard_pieces: int = 4096, islands: int = 3, epochs: int = 3) -> DataFrame:
    """pieces (id first, with ``length`` up to size) with sequence_id and offset: gapless from 0 in each sequence.

    Pieces are told apart as rows, so nulls, ties and repeated rows are packed like any other. An empty table gives an
    empty one. A shard, about ``shard_pieces`` pieces, is what a task holds at once, whatever the input's size.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select(*names).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    shards = max(1, math.ceil(rows.count() / shard_pieces))
    shard = F.pmod(F.xxhash64("_row"), F.lit(shards))
    ordered = F.sort_array(F.collect_list(F.struct("length", "_row", *[c for c in names if c != "length"])), asc=False)
    whole = written(rows.groupBy(shard.alias("shard")).agg(ordered.alias("rows")), "pack-shards")
    lengths = F.transform("rows", lambda r: r["length"].cast("int"))
    old = islands_of(whole.select("shard", lengths.alias("lengths")), size, shards, islands, epochs)
    best = old.groupBy("shard").agg(F.max_by(F.col("elites")[0], F.struct(-F.col("bins"), "squares", "island")).alias("placed"))
    laid = whole.join(best, "shard").select("shard", "placed", "rows").repartition(max(1, math.ceil(shards / 8)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room()
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("shard")[i].as_py()
                structs = batch.column("rows").slice(i, 1).flatten()
                size_of = structs.field("length").to_numpy(zero_copy_only=False)
                lengths = size_of.tolist()
                placed = np.array(_placed(settled(lengths, size, _packing(lengths, batch.column("placed")[i].as_py())), len(lengths)), np.int64)
                order = np.argsort(placed, kind="stable")
                ends = np.cumsum(size_of[order])
                fresh = np.concatenate([[0], np.flatnonzero(np.diff(placed[order])) + 1])
                first = np.repeat((ends - size_of[order])[fresh], np.diff(np.append(fresh, len(order))))
                offset = np.empty(len(order), np.int64)
                offset[order] = ends - size_of[order] - first
                yield pa.RecordBatch.from_arrays([*(structs.field(c) for c in names), pa.array((number << 24) + placed), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return laid.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "sequence_id long", "offset long"]))


def pack_documents(df: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: a document of the end id alone. Documents of any length are cut only if longer than ``size``.
    Null and repeated ids are documents of their own; other columns are not read; an empty table gives an empty one.
    """
    return pack(token_pieces(df, tokenizer_path, size, 0, id_col, text_col), size)
