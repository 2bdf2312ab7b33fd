"""Substring dedup: words inside windows that occur more than once, found by level-wise doubling of the window.

A window is ``size`` words. Level 1 looks at runs of about a quarter of that, and only at those that are the least (by
hash) of some window: equal windows have equal least runs, so a window whose least run occurs once can't be repeated.
Level 2 doubles the survivors to either side, and also takes the whole stretch of windows that share a least run: where
that stretch occurs again, all its windows are repeated and need no more looking at. Level 3 compares what is left, the
windows at the ends of repeated passages, at full length. Each level counts hashes with map-side sums, so a passage in a
third of all documents is one row a task, and only survivors go on.

Texts with the same words are one text from the start. Texts are fetched for a level by key, after a fixed-size bitmap
has turned away most that have no survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import byte_slices, discard, makes_room, texts_of, written
from graphloom.llm.word_hashes import WORDS, Runs, mixed

SLICE = 1 << 20
#: Bits of the bitmap that turns texts away; beyond some tens of millions of survivors it turns away fewer, never wrongly.
BITMAP_BITS = 1 << 25
MOST_OFTEN = 64


def least_runs(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` neighbouring hashes the place of its least, the leftmost of equals."""
    at = np.arange(len(h))
    done = 1
    while done < span:
        step = min(done, span - done)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        done += step
    return at


class Stretches:
    """The least runs of the windows of many texts laid end to end, with the windows that share each of them."""

    def __init__(self, split: list[list[bytes]], size: int, part: int):
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        words = WORDS.of([w for x in split for w in x])
        self.runs = Runs(words)
        n, span = len(words), size - part + 1
        none = np.zeros(0, np.int64)
        self.least = self.lo = self.hi = self.owner = none
        if n < size:
            return
        least = least_runs(self.runs.at(np.arange(n - part + 1), part).view(np.uint64), span)
        start = np.arange(len(least))
        owner = np.repeat(np.arange(len(split)), self.sizes)[: len(start)]
        inside = start + size <= self.ends[owner]
        least, start, owner = least[inside], start[inside], owner[inside]
        if not len(start):
            return
        # windows with the same least run are neighbours: it moves on, never back
        first = np.concatenate([[0], np.flatnonzero((np.diff(least) != 0) | (np.diff(owner) != 0)) + 1])
        last = np.concatenate([first[1:], [len(start)]]) - 1
        self.least, self.owner, self.lo, self.hi = least[first], owner[first], start[first], start[last]

    def local(self, x: np.ndarray) -> np.ndarray:
        """Places in the texts laid end to end as places in their own text."""
        return x - self.begins[self.owner]


def _text_key(words: list[bytes]) -> tuple[int, int]:
    d = blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values, in rows of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _rows_bit(k1: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    ids = doc_id.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mixed(k1.view(np.uint64) ^ mixed(ids)) % np.uint64(BITMAP_BITS)


def _read(source: DataFrame, size: int, part: int) -> DataFrame:
    """Level 1 of each row: id, key, number of words, hash of all words, and its least runs as hashes with places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                split = [t.split() for t in texts_of(batch, "text")]
                keys = [_text_key(w) for w in split]
                s = Stretches(split, size, part)
                per_text = np.bincount(s.owner, minlength=len(split))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([a for a, _ in keys], pa.int64()),
                        pa.array([b for _, b in keys], pa.int64()),
                        pa.array(s.sizes),
                        pa.array([sha256(b" ".join(w)).hexdigest() for w in split]),
                        _lists(s.runs.at(s.least, part), per_text, pa.int64()),
                        _lists(s.local(s.least), per_text, pa.int32()),
                    ],
                    names=["doc_id", "k1", "k2", "n_words", "sha", "h", "at"],
                )

    return source.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, sha string, h array<long>, at array<int>")


def _fetch(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (k1, k2, doc_id and more) with the text of each. Null and -1 aren't told apart in ids: both texts come,
    and as the two are copies, that changes no answer."""
    words = _bitmap(wanted)
    shared = source.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        bits = shared.value
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                keys = [_text_key(t.split()) for t in texts_of(batch, "text")]
                k1 = np.array([a for a, _ in keys], np.int64)
                bit = _rows_bit(k1, batch.column("doc_id"))
                kept = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                if kept.any():
                    full = pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1), pa.array([b for _, b in keys], pa.int64())], names=["doc_id", "text", "k1", "k2"])
                    yield full.filter(pa.array(kept))

    texts = source.mapInArrow(run, "doc_id long, text string, k1 long, k2 long").withColumn("_id", _known(F.col("doc_id")))
    wanted = wanted.withColumn("_id", _known(F.col("doc_id"))).drop("doc_id")
    return texts.join(wanted.hint("shuffle_hash"), ["k1", "k2", "_id"])


def _known(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-1).cast("long"))


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """A bit for each row of wanted, gathered as at most BITMAP_BITS / 64 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS // 64, np.uint64)
        for batch in batches:
            bit = _rows_bit(batch.column("k1").to_numpy(), batch.column("doc_id"))
            np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = wanted.select("k1", "doc_id").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _of_repeated(rows: DataFrame, shown: DataFrame, total: DataFrame, *more: Column) -> DataFrame:
    """The rows whose hash ``h`` shown has more than once, with what more says of that hash. total: one row, how many
    rows shown has.

    A hash on more than a MOST_OFTEN-th of them is one of fewer than MOST_OFTEN: those are broadcast, so that the rows
    of no single hash are dealt to one task.
    """
    found = written(shown.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), *more).filter("_n > 1"), "repeats-found")
    often = [r["h"] for r in found.filter(F.col("_n") > (total.first()[0] or 0) // MOST_OFTEN).select("h").collect()]
    if not often:
        return rows.join(found.drop("_n"), "h")
    hot = F.col("h").isin(often)
    some = rows.filter(~hot).join(found.filter(~hot).drop("_n"), "h")
    return some.unionByName(rows.filter(hot).join(F.broadcast(found.filter(hot).drop("_n")), "h"))


def _double(fetched: DataFrame, size: int, part: int) -> DataFrame:
    """Level 2 of texts with surviving least runs: for each, the hashes at twice the length and of the whole stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                split = [t.split() for t in texts_of(batch, "text")]
                s = Stretches(split, size, part)
                alive = _among(s, batch.column("alive"))
                at, lo, hi, owner = s.least[alive], s.lo[alive], s.hi[alive], s.owner[alive]
                right = at + 2 * part <= s.ends[owner]
                left = at - part >= s.begins[owner]
                h = np.concatenate([s.runs.at(at[right], 2 * part, 1), s.runs.at(at[left] - part, 2 * part, 2), s.runs.at(lo, hi - lo + size, 3)])
                who = np.concatenate([owner[right], owner[left], owner])
                code = np.concatenate([(at[right] - s.begins[owner[right]]) * 4, (at[left] - s.begins[owner[left]]) * 4 + 1, (at - s.begins[owner]) * 4 + 2])
                order = np.argsort(who, kind="stable")
                n = np.bincount(who, minlength=len(split))
                yield pa.RecordBatch.from_arrays([batch.column("tid"), _lists(h[order], n, pa.int64()), _lists(code[order], n, pa.int64())], names=["tid", "h", "code"])

    return fetched.select("tid", "text", "alive").mapInArrow(run, "tid long, h array<long>, code array<long>")


def _among(s: Stretches, lists: pa.Array) -> np.ndarray:
    """Which stretches' least runs are in their text's list of places."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    listed = flat + np.repeat(s.begins, n)
    return np.isin(s.least, listed)


def _ends(fetched: DataFrame, size: int, part: int) -> DataFrame:
    """Level 3: settled stretches as ranges of windows, and full-length hashes of the windows still in question.

    Of each settled stretch one text alone (``first``) also hashes its windows, for others' windows to be found in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                split = [t.split() for t in texts_of(batch, "text")]
                s = Stretches(split, size, part)
                codes = batch.column("codes")
                flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = (flat >> 3) + np.repeat(s.begins, codes.value_lengths().to_numpy(zero_copy_only=False))
                kind = flat & 7  # 0: right half repeated, 1: left, 2: stretch, +4: first of its kind
                has = lambda k: np.isin(s.least, place[k])
                settled, first = has((kind & 3) == 2), has(kind == 6)
                right, left = has((kind & 3) == 0) & ~settled, has((kind & 3) == 1) & ~settled
                # windows whose least run starts at most 2 * part words before their end hold its right double
                reach = size - 2 * part
                lo, hi = s.lo, s.hi
                edge = np.clip(s.least - reach, lo, hi + 1)  # from here on windows hold the right double, before it the left
                begin = np.concatenate([np.where(left, lo, edge), np.where(right, edge, hi + 1)])
                stop = np.concatenate([edge, np.full(len(lo), 0) + hi + 1])
                who = np.concatenate([s.owner, s.owner])
                asked_at, asked_who = _expand(begin, np.where(np.concatenate([left, right]), stop, begin), who)
                shown_at, shown_who = _expand(lo[first], hi[first] + 1, s.owner[first])
                a, b = np.argsort(asked_who, kind="stable"), np.argsort(shown_who, kind="stable")
                n = len(split)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("tid"),
                        _lists(s.local(lo)[settled], np.bincount(s.owner[settled], minlength=n), pa.int32()),
                        _lists(s.local(hi)[settled], np.bincount(s.owner[settled], minlength=n), pa.int32()),
                        _lists(s.runs.at(asked_at, size, 4)[a], np.bincount(asked_who, minlength=n), pa.int64()),
                        _lists((asked_at - s.begins[asked_who])[a], np.bincount(asked_who, minlength=n), pa.int32()),
                        _lists(s.runs.at(shown_at, size, 4)[b], np.bincount(shown_who, minlength=n), pa.int64()),
                    ],
                    names=["tid", "lo", "hi", "asked", "at", "shown"],
                )

    kinds = "tid long, lo array<int>, hi array<int>, asked array<long>, at array<int>, shown array<long>"
    return fetched.select("tid", "text", "codes").mapInArrow(run, kinds)


def _expand(begin: np.ndarray, stop: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [begin, stop), with each range's owner."""
    n = np.maximum(0, stop - begin)
    first = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else begin, n)
    return first + np.arange(len(first)), np.repeat(who, n)


def _decide(source: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, key, counts), texts (key, copies, one id), and for lone texts the windows that go (lo, hi, hits)."""
    part = max(1, size // 4 + (size % 4 > 2))
    rows = written(_read(source, size, part), "repeats-rows")
    texts = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("h").alias("h"), F.first("at").alias("at"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "repeats-texts")

    runs = texts.select("tid", F.explode(F.arrays_zip("h", "at")).alias("r")).select("tid", "r.h", "r.at")
    alive = _of_repeated(runs, runs.select("h"), texts.agg(F.sum(F.size("h")))).groupBy("tid").agg(F.collect_list("at").alias("alive"))
    alive = written(texts.select("tid", "k1", "k2", "doc_id", "copies").join(alive, "tid"), "repeats-alive")

    halves = written(_double(_fetch(source, alive), size, part), "repeats-halves")
    each = halves.select("tid", F.explode(F.arrays_zip("h", "code")).alias("r")).select("tid", "r.h", "r.code")
    code = F.col("code") * 2 - F.col("code") % 4 + F.when(F.col("first") == F.col("tid"), 4).otherwise(0)
    twice = _of_repeated(each, each.select("h", "tid"), halves.agg(F.sum(F.size("h"))), F.min("tid").alias("first"))
    codes = twice.groupBy("tid").agg(F.collect_list(code).alias("codes"))
    codes = written(alive.drop("alive").join(codes, "tid"), "repeats-codes")
    discard(halves)

    ends = written(_ends(_fetch(source, codes), size, part), "repeats-ends")
    asked = ends.select("tid", F.explode(F.arrays_zip("asked", "at")).alias("r")).select("tid", F.col("r.asked").alias("h"), "r.at")
    shown = ends.select(F.explode(F.concat("asked", "shown")).alias("h"))
    hits = _of_repeated(asked, shown, ends.agg(F.sum(F.size("asked") + F.size("shown")))).groupBy("tid").agg(F.collect_list("at").alias("hits"))
    none = F.array().cast("array<int>")
    starts = ends.select("tid", "lo", "hi").join(hits, "tid", "left").select("tid", "lo", "hi", F.coalesce("hits", none).alias("hits"))
    starts = starts.filter((F.size("lo") > 0) | (F.size("hits") > 0))
    cut = codes.filter("copies = 1").select("tid", "k1", "k2", "doc_id").join(starts, "tid").drop("tid")
    cut = written(cut, "repeats-cut")
    discard(ends)
    return rows, texts, cut


def remove_repeats(df: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256.

    Words are runs of characters other than ASCII spaces, as they are. A word goes if a window of ``size`` words around
    it occurs again, in the same text, in another or in a repeated row. The hash is of what is kept, joined by single
    spaces. A null text has no words. Null and repeated ids are rows of their own; other columns are not read; an empty
    table gives an empty one. Whole texts are read; a batch or the longest text is in memory. ``size`` is 4 or more.
    """
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows, texts, cut = _decide(source, size)
    gone = (F.col("copies") > 1) & (F.col("n_words") >= size)
    plain = rows.select("doc_id", "k1", "k2", "n_words", "sha").join(texts.select("k1", "k2", "copies"), ["k1", "k2"])
    plain = plain.join(cut.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    shortened = _fetch(source, cut).select("doc_id", "text", "lo", "hi", "hits").mapInArrow(_digests(size), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return plain.unionByName(shortened).withColumnRenamed("doc_id", id_col)


def without_repeats(df: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated words gone: a text that loses words becomes those kept, joined by single spaces.

    Texts that lose none stand as they are, and null stays null. Otherwise as ``remove_repeats``; all columns stay.
    """
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    _, texts, cut = _decide(source, size)
    none = F.array().cast("array<int>")
    gone = texts.filter((F.col("copies") > 1) & (F.col("n_words") >= size)).select("k1", "k2", none.alias("lo"), none.alias("hi"), none.alias("hits"), F.lit(True).alias("all"))
    plan = gone.unionByName(cut.select("k1", "k2", "lo", "hi", "hits", F.lit(False).alias("all")))
    names = df.columns
    place = names.index(text_col)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [f"c{i} {t}" for i, (_, t) in enumerate(df.dtypes)]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, f"c{place}", SLICE):
                keys = [_text_key(t.split()) for t in texts_of(batch, f"c{place}")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64())], names=[*batch.schema.names, "k1", "k2"])

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, f"c{place}", SLICE):
                out = []
                for text, all_, *lists in zip(batch.column(f"c{place}").to_pylist(), *(batch.column(c).to_pylist() for c in ("all", "lo", "hi", "hits"))):
                    if all_ is None or text is None:
                        out.append(text)
                    else:
                        out.append("" if all_ else _kept(text.encode().split(), *lists, size)[1].decode())
                columns = list(batch.columns[: len(names)])
                columns[place] = pa.array(out, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    joined = rows.mapInArrow(key, ", ".join([*kinds, "k1 long", "k2 long"])).join(plan.hint("shuffle_hash"), ["k1", "k2"], "left")
    joined = joined.select(*[f"c{i}" for i in range(len(names))], "all", "lo", "hi", "hits")
    out = joined.mapInArrow(cutting, ", ".join(kinds))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _kept(words: list[bytes], lo, hi, hits, size: int) -> tuple[int, bytes]:
    """Number and text of the words outside the windows that start in [lo, hi] ranges and at hits."""
    change = np.zeros(len(words) + 1, np.int64)
    lo, hi, hits = (np.array(x, np.int64) for x in (lo, hi, hits))
    np.add.at(change, np.concatenate([lo, hits]), 1)
    np.add.at(change, np.concatenate([hi, hits]) + size, -1)
    at = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return len(at), b" ".join([words[i] for i in at])


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                sizes, removed, shas = [], [], []
                for text, *lists in zip(texts_of(batch, "text"), *(batch.column(c).to_pylist() for c in ("lo", "hi", "hits"))):
                    words = text.split()
                    n, kept = _kept(words, *lists, size)
                    sizes.append(len(words))
                    removed.append(len(words) - n)
                    shas.append(sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run
