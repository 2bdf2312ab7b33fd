"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets, as groups of linked documents.

Jaccard distance is a metric. Two documents are linked within a radius; the join finds all links that matter for which
documents hang together:

1. Equal sets become one.
2. First pivots. In hash order, sets within the radius share one of their first few shingles and have similar sizes. So
   each (shingle, size band) has a pivot, its first document, and the documents under a pivot form its region; a
   document near several pivots, or at the edge of a size band, is replicated to each region. Very frequent shingles
   come last in the order, which keeps common passages from being anyone's first shingles.
3. Regions are thinned by profiles (how many of a set's shingles each of some hash classes has; larger sets have more
   classes) and then join on sketches (the part of each set in a fixed fraction of hash space; symmetric difference is a
   metric too). Profiles or sketches that differ by more than whole sets may, part documents exactly. What hangs together
   in a region goes on to a join on whole sets.
4. Both joins go the same way (``Region``): pivots, each the farthest from those before; a Voronoi cell for each, with
   the documents nearest to it and, by the triangle inequality, those less than twice the radius farther from it than
   from their own pivot; a cell for the documents far from all pivots; and each cell joined in the same way, until it
   has a few documents. A document within the radius of a pivot is linked to it; two documents already linked through
   others aren't compared again.

A region larger than a task should hold is parted by the same pivots, cells and windows as a distributed step, turn by
turn (``_parted``): documents within the radius of a cell's pivot hang together by it, so only the cell's others are
compared with all. What cells can't part (all at about the same distance) is joined as pairs of blocks, exactly as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import connected
from graphloom.llm.shared import byte_slices, discard, makes_room, texts_of, written
from graphloom.llm.word_hashes import WORDS, Runs, mixed

SLICE = 1 << 20
BITMAP_BITS = 1 << 25
#: At most so many shingles count as very frequent: those on more than this fraction of all prefix rows.
MOST_HOT = 1 << 20
#: A cell of so many documents is compared pair by pair.
LEAF = 3
PIVOTS = 16
#: Of a region to be parted about so many documents are candidates for pivots.
SAMPLE = 512
TURNS = 3
#: A profile has so many classes at least, and its numbers stop at MOST_COUNTED.
CLASSES = 64
MOST_COUNTED = 65535


class Likeness:
    """Linked if ``den * intersection >= num * union``, for sets of ``width``-word shingles; all bounds in integers."""

    def __init__(self, num: int, den: int, width: int):
        self.num, self.den, self.width = num, den, width
        self.need = need = 2 * (den - num) / (den + num)  # largest difference of linked sets, per element of one
        self.sketch_bits = 0
        while self.sketch_bits < 6 and 2.0 ** -(self.sketch_bits + 1) * 2 > 1.9 * need:
            self.sketch_bits += 1

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets whose sizes sum to total."""
        return total - 2 * -(-self.num * total // (self.den + self.num))

    def probe(self, n: np.ndarray) -> np.ndarray:
        """First shingles of a set among which one of any linked set's index is."""
        return np.where(n > 0, n + (-self.num * n // self.den) + 1, 0)

    def index(self, n: np.ndarray) -> np.ndarray:
        """First shingles of the smaller of two linked sets among which one of the larger's probe is."""
        return np.where(n > 0, n + (-2 * self.num * n // (self.den + self.num)) + 1, 0)

    def band(self, n: np.ndarray) -> np.ndarray:
        """Sizes of linked sets are in the same band or in neighbouring ones."""
        width = np.log(self.den / self.num) * (1 + 1e-9) if self.num < self.den else 1e-9
        return np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64)

    def classes(self, n: np.ndarray) -> np.ndarray:
        """Classes of the profile of a set of size n, a power of two. Profiles of two unrelated sets differ by about
        1.13 * sqrt(classes * n), and so many classes make that 1.5 times what linked sets may differ by, at least."""
        least = np.maximum(CLASSES, n * (1.5 / 1.13 * self.need) ** 2)
        return np.int64(1) << np.ceil(np.log2(least)).astype(np.int64)

    def reach(self, n: np.ndarray, exact: bool) -> np.ndarray:
        """No set linked with one of size n is farther from it."""
        if exact:
            return np.full(len(n), 1 - self.num / self.den + 1e-9)
        return (n + n * self.den / self.num) * (self.den - self.num) / (self.den + self.num) + 1e-6


def windows(place: np.ndarray, reach: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells documents are in, by their distances to pivots: (near some pivot, in the cell of each, far from all).

    Of two linked documents both near a pivot, each is less than twice the reach farther from the other's pivot than
    from its own, so both are in a cell together. If one is far from all pivots, the other is almost as far, and both
    are among the far ones. If no document is far, none needs that cell. Sketches have no greatest distance: none are far.
    """
    nearest = place.min(axis=1)
    edge = 1 - 3 * reach[0] if exact and reach[0] < 0.25 else np.inf  # a wide radius leaves no room between near and far
    near = nearest <= edge
    inside = near[:, None] & (place <= (nearest + 2 * reach)[:, None])
    return near, inside, np.zeros(len(near), bool) if near.all() else nearest > edge - reach


class Sets:
    """Shingle sets of many texts, sorted by hash, end to end."""

    def __init__(self, texts: list[bytes], like: Likeness):
        split = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        runs = Runs(WORDS.of([w for x in split for w in x]))
        width = np.minimum(like.width, sizes)
        count = np.where(sizes > 0, sizes - width + 1, 0)
        owner = np.repeat(np.arange(len(split)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)
        h = runs.at(at, width[owner], 11).view(np.uint64)
        h = mixed(h ^ width[owner].astype(np.uint64), 12)
        end = np.cumsum(count)
        for b, e in zip((end - count).tolist(), end.tolist()):
            h[b:e].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.h, self.owner = h[fresh], owner[fresh]
        self.n = np.bincount(self.owner, minlength=len(split))
        self.begin = np.cumsum(self.n) - self.n
        self.rank = np.arange(len(self.h)) - self.begin[self.owner]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (1, 2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.h, salt), dtype=np.uint64)])
            out.append(mixed(sums[self.begin + self.n] - sums[self.begin], salt).view(np.int64))
        return out[0], out[1]

    def profiles(self, like: Likeness) -> list[bytes]:
        """How many shingles fall into each class, as unsigned 16-bit numbers that stop at the highest."""
        classes = like.classes(self.n)
        end = np.cumsum(classes)
        of = (end - classes)[self.owner] + (self.h & (classes[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        counts = np.minimum(np.bincount(of, minlength=int(classes.sum())), MOST_COUNTED).astype("<u2")
        return [counts[b:e].tobytes() for b, e in zip((end - classes).tolist(), end.tolist())]

    def lists(self, chosen: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        sizes = np.bincount(self.owner[chosen], minlength=len(self.n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values[chosen], kind))


def _text_keys(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def _bit(t1: np.ndarray) -> np.ndarray:
    return mixed(t1.view(np.uint64), 21) % np.uint64(BITMAP_BITS)


def _bitmap(texts: DataFrame) -> np.ndarray:
    """A bit for each text key (t1), gathered as at most BITMAP_BITS / 64 words. It may let others pass, never less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS // 64, np.uint64)
        for batch in batches:
            bit = _bit(batch.column("t1").to_numpy())
            np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = texts.select("t1").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _passing(batch: pa.RecordBatch, bits: np.ndarray) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Texts of the batch whose key the bitmap has, with their keys and rows."""
    texts = texts_of(batch, "text")
    keys = _text_keys(texts)
    bit = _bit(np.ascontiguousarray(keys[:, 0]))
    rows = np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).tolist()
    return [texts[i] for i in rows], keys[rows], rows


def _read(source: DataFrame, like: Likeness) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                texts = texts_of(batch, "text")
                s = Sets(texts, like)
                keys, (k1, k2) = _text_keys(texts), s.keys()
                first = s.rank < like.probe(s.n)[s.owner]
                low = s.h < np.uint64((1 << (64 - like.sketch_bits)) - 1)
                short = (s.h >> np.uint64(32 - like.sketch_bits)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(k1),
                        pa.array(k2),
                        pa.array(s.n),
                        pa.array(np.ascontiguousarray(keys[:, 0])),
                        pa.array(np.ascontiguousarray(keys[:, 1])),
                        s.lists(first, s.h.view(np.int64), pa.int64()),
                        s.lists(low, short, pa.int32()),
                        pa.array(s.profiles(like), pa.binary()),
                    ],
                    names=["doc_id", "k1", "k2", "n", "t1", "t2", "first", "sketch", "profile"],
                )

    return source.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, t1 long, t2 long, first array<long>, sketch array<int>, profile binary")


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles that so many sets have among their first that no more than MOST_HOT can."""
    each = sets.select(F.explode("first").alias("h"))
    total = sets.agg(F.sum(F.size("first"))).first()[0] or 0
    least = max(128, total // MOST_HOT)
    found = each.groupBy("h").count().filter(F.col("count") > least).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def _reordered(source: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """sets with each one's first shingles where very frequent shingles come last, for those that have any."""
    hot = _frequent(sets)
    if not len(hot):
        return sets.select("tid", "n", "first")
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("first")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield batch.append_column("hot", pa.array(np.bincount(owner[np.isin(flat, shared.value)], minlength=batch.num_rows) > 0))

    flagged = written(sets.select("tid", "n", "doc_id", "t1", "t2", "first").mapInArrow(marked, "tid long, n long, doc_id long, t1 long, t2 long, first array<long>, hot boolean"), "jaccard-flagged")
    again = flagged.filter("hot").select("tid", "n", "doc_id", "t1", "t2")
    bits = spark.sparkContext.broadcast(_bitmap(again))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                texts, keys, rows = _passing(batch, bits.value)
                if not texts:
                    continue
                s = Sets(texts, like)
                late = np.isin(s.h, shared.value)
                order = np.lexsort((s.h, late, s.owner))
                s.h = s.h[order]
                first = s.rank < like.probe(s.n)[s.owner]
                columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), s.lists(first, s.h.view(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "first"])

    fresh = source.mapInArrow(run, "doc_id long, t1 long, t2 long, first array<long>")
    fresh = fresh.join(again.hint("shuffle_hash"), _same_text(fresh, again)).select("tid", "n", "first")
    out = written(flagged.filter("not hot").select("tid", "n", "first").unionByName(fresh), "jaccard-first")
    discard(flagged)
    return out


def _same_text(a: DataFrame, b: DataFrame):
    return (a["t1"] == b["t1"]) & (a["t2"] == b["t2"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _regions(firsts: DataFrame, like: Likeness) -> DataFrame:
    """(pivot, tid): for each shingle and size band with two sets or more, its first set and each of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            lists = batch.column("first")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            band = like.band(n)[owner]
            visits = rank < like.index(n)[owner]  # as the smaller of two, also in the next band
            every, next_ = np.concatenate([flat, flat[visits]]), np.concatenate([band, band[visits] + 1])
            key = mixed(every ^ mixed(next_.view(np.uint64), 31), 32)
            tid = batch.column("tid").to_numpy()[np.concatenate([owner, owner[visits]])]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mixed(tid.view(np.uint64), 33).view(np.int64)), pa.array(tid)], names=["key", "turn", "tid"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and pivot of the group at the end of the last batch, and whether it is still alone
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tid = batch.column("key").to_numpy(), batch.column("tid").to_numpy()
            fresh = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            begin = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            pivots = tid[begin]
            if not fresh[0]:
                group, pivots = group + 1, np.concatenate([[last[1]], pivots])
                begin = np.concatenate([[-1], begin])
            pivot = pivots[group]
            size = np.bincount(group, minlength=len(pivots))
            member = pivot != tid
            # a pivot is a member of its own region; once is enough however many of its groups there are
            heads_ = np.unique(pivot[member])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pivot[member], heads_])), pa.array(np.concatenate([tid[member], heads_]))], names=["pivot", "tid"])
            last = (key[-1], pivots[-1], size[-1])

    rows = firsts.mapInArrow(spread, "key long, turn long, tid long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "turn", "tid").select("key", "tid")
    return dealt.mapInArrow(heads, "pivot long, tid long").distinct()


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, others: np.ndarray) -> None:
        roots = {self.root(int(y)) for y in others} | {self.root(x)}
        least = min(roots)
        for r in roots:
            self.up[r] = least

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            higher = up[up]
            if (higher == up).all():
                self.up = up
                return up
            up = higher


class Region:
    """The members of one region, as sorted arrays end to end, joined recursively by pivots.

    ``sizes`` are those of whole sets. If the arrays are whole sets (``exact``), distance is Jaccard's and the radius
    1 - num/den; for sketches it is the symmetric difference, a lower bound of that of whole sets. ``cells`` and ``far``
    count the Voronoi cells that were joined and how often documents far from all pivots went on by themselves.
    """

    def __init__(self, arrays: list[np.ndarray], sizes: np.ndarray, like: Likeness, exact: bool):
        self.arrays, self.sizes, self.like, self.exact = arrays, sizes, like, exact
        self.held = np.fromiter(map(len, arrays), np.int64, len(arrays))
        self.union = Union(len(arrays))
        self.cells = self.far = 0

    def apart(self, own: np.ndarray, ids: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Symmetric difference of a sorted array and those of each of ids, which are in flat from begin on."""
        if not len(own) or not len(flat):
            return len(own) + self.held[ids]
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
        return len(own) + self.held[ids] - 2 * (hits[begin + self.held[ids]] - hits[begin])

    def linked(self, size: int, ids: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return apart <= self.like.most_apart(size + self.sizes[ids])

    def distance(self, held: int, ids: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return 2 * apart / np.maximum(1, held + self.held[ids] + apart) if self.exact else apart.astype(float)

    def laid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ids end to end, and where each begins."""
        return np.concatenate([self.arrays[i] for i in ids]), np.cumsum(self.held[ids]) - self.held[ids]

    def pivots(self, ids: np.ndarray, most: int, flat: np.ndarray, begin: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Pivots, each the farthest from those before, and the distance of each id to each. Who is within the radius
        of a pivot is joined to it; pivots end early where all hang together or no id is away from all of them."""
        chosen, columns, at = [], [], 0
        nearest = np.full(len(ids), np.inf)
        while len(chosen) < most and nearest[at] > 0:
            p = int(ids[at])
            apart = self.apart(self.arrays[p], ids, flat, begin)
            if (near := ids[self.linked(self.sizes[p], ids, apart)]).size:
                self.union.join(p, near)
                if len(near) == len(ids) and not chosen:
                    return [p], self.distance(self.held[p], ids, apart)[:, None]
            chosen.append(p)
            columns.append(self.distance(self.held[p], ids, apart))
            nearest = np.minimum(nearest, columns[-1])
            at = int(nearest.argmax())
        return chosen, np.stack(columns, 1)

    def roots(self) -> np.ndarray:
        self._join(np.arange(len(self.arrays)), 0)
        return self.union.roots()

    def _join(self, ids: np.ndarray, depth: int) -> None:
        """Joins ids; those far from all pivots go on in this loop, cells one level down."""
        whole = self.union.roots
        while len(ids) > 1 and (whole()[ids] != whole()[ids[0]]).any():
            flat, begin = self.laid(ids)
            if len(ids) <= LEAF or depth > 12:
                return self._scan(ids, flat, begin, np.empty((len(ids), 0)))
            _, place = self.pivots(ids, min(PIVOTS, max(2, len(ids) // 4)), flat, begin)
            if (whole()[ids] == whole()[ids[0]]).all():
                return
            _, inside, far = windows(place, self.like.reach(self.sizes[ids], self.exact), self.exact)
            cells = [ids[inside[:, j]] for j in range(place.shape[1])]
            # parts whose squares sum to less than the whole's are worth taking, and keep all of the recursion below n²
            if sum(len(c) ** 2 for c in cells) + far.sum() ** 2 > 0.8 * len(ids) ** 2:
                return self._scan(ids, flat, begin, place)
            for cell in cells:
                self.cells += 1
                self._join(cell, depth + 1)
            self.far += int(far.any())
            ids = ids[far]

    def _scan(self, ids: np.ndarray, flat: np.ndarray, begin: np.ndarray, place: np.ndarray) -> None:
        """All pairs that the pivots' windows and the sizes leave and that aren't linked through others yet."""
        sizes = self.sizes[ids]
        num, den = self.like.num, self.like.den
        roots = self.union.roots()[ids]
        for i in range(len(ids) - 1):
            x, rest = int(ids[i]), slice(i + 1, None)
            ok = roots[rest] != roots[i]
            ok &= (den * sizes[rest] >= num * sizes[i]) & (den * sizes[i] >= num * sizes[rest])
            if place.shape[1] and ok.any():
                ok &= np.abs(place[rest] - place[i]).max(axis=1) <= self.like.reach(sizes[i : i + 1], self.exact)
            found = np.flatnonzero(ok) + i + 1
            if not len(found):
                continue
            if 4 * len(found) > len(ids):
                apart = self.apart(self.arrays[x], ids, flat, begin)[found]
            else:
                apart = self.apart(self.arrays[x], ids[found], *self.laid(ids[found]))
            near = ids[found][self.linked(sizes[i], ids[found], apart)]
            if len(near):
                self.union.join(x, near)
                roots = self.union.roots()[ids]


def _folded(profiles: list[bytes], classes: int) -> np.ndarray:
    """Profiles of so many classes or more, all as if they had so many: a class holds those equal to it in its low bits."""
    out = np.empty((len(profiles), classes), np.int32)
    held = np.fromiter(map(len, profiles), np.int64, len(profiles)) // 2
    for k in np.unique(held).tolist():
        some = np.flatnonzero(held == k)
        fine = np.frombuffer(b"".join([profiles[i] for i in some]), "<u2").reshape(len(some), k // classes, classes)
        out[some] = np.minimum(fine.sum(1, dtype=np.int32), MOST_COUNTED)
    return out


def _thinned(regions: DataFrame, sets: DataFrame, like: Likeness, most: int) -> DataFrame:
    """regions (region, tid) without members whose profile and size keep them from all others of their region.

    A region of more than ``most`` members stays as it is, and isn't gathered.
    """
    large = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most).select("region")
    large = written(large, "jaccard-large")
    as_is = None if large.isEmpty() else regions.join(large, "region", "left_semi").select("region", "tid")
    if as_is is not None:
        regions = regions.join(large, "region", "left_anti")
    rows = regions.join(sets.select("tid", "n", "profile"), "tid").select("region", "tid", "n", "profile")
    dealt = rows.repartition("region").sortWithinPartitions("region")

    def kept(region: int, tid: list, n: list, profile: list) -> list[tuple]:
        if len(tid) < 2:
            return []
        order = sorted(range(len(tid)), key=lambda i: len(profile[i]))  # two sets are compared in the fewer classes of both
        tid, profile, sizes = [tid[i] for i in order], [profile[i] for i in order], np.array(n, np.int64)[order]
        alive = np.zeros(len(tid), bool)
        counts, classes, begin = np.empty((0, 0), np.int32), 0, 0
        for i in range(len(tid) - 1):
            if len(profile[i]) != 2 * classes:
                classes, begin = len(profile[i]) // 2, i
                counts = _folded(profile[i:], classes)
            rest = slice(i + 1, None)
            ok = (like.den * sizes[rest] >= like.num * sizes[i]) & (like.den * sizes[i] >= like.num * sizes[rest]) & ~(alive[rest] & alive[i])
            found = np.flatnonzero(ok) + i + 1
            if len(found):
                near = found[np.abs(counts[found - begin] - counts[i - begin]).sum(1) <= like.most_apart(sizes[found] + sizes[i])]
                alive[near] = True
                alive[i] |= len(near) > 0
        return [(region, tid[i]) for i in np.flatnonzero(alive)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        region, tids, sizes, profiles = None, [], [], []
        for batch in batches:
            out: list[tuple] = []
            for r, t, n, p in zip(*(batch.column(c).to_pylist() for c in ("region", "tid", "n", "profile"))):
                if r != region:
                    out += kept(region, tids, sizes, profiles)
                    region, tids, sizes, profiles = r, [], [], []
                tids.append(t)
                sizes.append(n)
                profiles.append(p)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["region", "tid"])
        out = kept(region, tids, sizes, profiles)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["region", "tid"])

    thin = dealt.mapInArrow(run, "region long, tid long").distinct()
    return thin if as_is is None else thin.unionByName(as_is)


MEMBER = ("region", "tid", "n", "items")


def _grouped(batches: Iterator[pa.RecordBatch], key: str, exact: bool) -> Iterator[tuple[dict[str, np.ndarray], list[np.ndarray]]]:
    """(other columns, items) of the rows of each key; rows come sorted by it."""
    kind, signed = (np.uint64, np.int64) if exact else (np.uint32, np.int32)

    def whole(parts: list) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        if len(parts) == 1:
            return parts[0]
        return {c: np.concatenate([p[0][c] for p in parts]) for c in parts[0][0]}, [x for p in parts for x in p[1]]

    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("items")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(signed).view(kind)
        items = np.split(flat, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "items"}
        keys = columns[key]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield whole(held)
                held = []
            last = keys[a]
            held.append(({c: v[a:b] for c, v in columns.items()}, items[a:b]))
    if held:
        yield whole(held)


def _list_array(arrays: list[np.ndarray], exact: bool) -> pa.Array:
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    signed = np.int64 if exact else np.int32
    flat = np.concatenate(arrays).view(signed) if len(arrays) else np.zeros(0, signed)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _parted(todo: DataFrame, like: Likeness, exact: bool, most: int) -> tuple[DataFrame, DataFrame]:
    """todo: members (region, tid, n, items) of regions of more than ``most``. Returns members of regions that a task can
    hold, and links (a, b) of pivots with members within the radius.

    A turn deals each region over tasks, with its pivots in each. A cell whose members all hang together by its pivot is
    done; in one where few don't, these go to every block of the others, with the pivot; larger ones are parted again.
    A region that cells don't part stays whole: in blocks like that, or as pairs of blocks.
    """
    kinds = dict(todo.dtypes)
    ready: list[DataFrame] = []
    links: list[DataFrame] = []

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, arrays in _grouped(batches, "region", exact):
            ids = np.arange(len(arrays))
            r = Region(arrays, rows["n"], like, exact)
            chosen, _ = r.pivots(ids, PIVOTS, *r.laid(ids))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][chosen]) for c in ("region", "tid", "n")), _list_array([arrays[i] for i in chosen], exact)], names=list(MEMBER))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, arrays in _grouped(batches, "part", exact):
            lead, ids = np.flatnonzero(rows["lead"]).tolist(), np.flatnonzero(~rows["lead"])
            if not len(ids):
                continue
            r, tids, n = Region(arrays, rows["n"], like, exact), rows["tid"], len(ids)
            flat, begin = r.laid(ids)
            apart = [r.apart(arrays[p], ids, flat, begin) for p in lead]
            ball = np.array([r.linked(r.sizes[p], ids, a) for p, a in zip(lead, apart)]).reshape(len(lead), n).T
            place = np.array([r.distance(r.held[p], ids, a) for p, a in zip(lead, apart)]).reshape(len(lead), n).T
            _, inside, far = windows(place, like.reach(r.sizes[ids], exact), exact) if lead else (None, None, np.ones(n, bool))
            region = int(rows["region"][0])
            for j in (*range(len(lead)), -1):
                some = np.flatnonzero(inside[:, j] if j >= 0 else far)
                if len(some):
                    n = len(some)
                    pivot = pa.array([int(tids[lead[j]])] * n if j >= 0 else [None] * n, pa.int64())
                    tied = pa.array(ball[some, j] if j >= 0 else np.zeros(n, bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([region] * n, pa.int64()), pa.array(tids[ids[some]]), pa.array(r.sizes[ids[some]]), _list_array([arrays[i] for i in ids[some]], exact), pivot, tied],
                        names=[*MEMBER, "pivot", "tied"],
                    )

    shape = f"region long, tid long, n long, items {kinds['items']}"
    for turn in range(TURNS):
        sizes = written(todo.groupBy("region").agg(F.count(F.lit(1)).alias("m")), "jaccard-sizes")
        counted = todo.join(sizes, "region")
        chance = F.pmod(F.xxhash64("tid", F.lit(turn)), F.lit(1 << 20)) * F.col("m")
        sample = counted.filter(chance < F.lit(SAMPLE << 20)).select(*MEMBER)
        chosen = written(sample.repartition("region").sortWithinPartitions("region", "tid").mapInArrow(pick, shape), "jaccard-pivots")
        blocks = F.ceil(F.col("m") / most).cast("int")
        part = lambda salt: F.xxhash64("region", salt)
        own = counted.select(*MEMBER, F.lit(False).alias("lead"), part(F.pmod(F.xxhash64("tid"), blocks).cast("int")).alias("part"))
        led = chosen.join(sizes, "region").select(*MEMBER, F.lit(True).alias("lead"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt")).select(*MEMBER, "lead", part(F.col("salt")).alias("part"))
        dealt = own.unionByName(led).repartition("part").sortWithinPartitions("part")
        cells = written(dealt.mapInArrow(deal, f"{shape}, pivot long, tied boolean"), "jaccard-cells")
        links.append(cells.filter("tied AND pivot <> tid").select(F.col("pivot").alias("a"), F.col("tid").alias("b")))
        of = cells.groupBy("region", "pivot").agg(F.count_if("tied").alias("tied_by"), F.count_if(~F.col("tied")).alias("loose"))
        whole, loose = F.col("tied_by") + F.col("loose"), F.col("loose")
        work = F.sum(F.when(loose > 0, whole * F.least(2 * loose, whole)).otherwise(0))
        most_tied = F.max(F.struct("tied_by", "pivot"))
        per = of.groupBy("region").agg(work.alias("work"), most_tied.alias("best")).join(sizes, "region")
        # cells are taken if that leaves clearly less to compare than the region itself, so turns add up to a bounded sum
        per = written(per.select(F.col("region").alias("r"), "m", (F.col("work") <= F.col("m") * F.col("m") * 0.5).alias("parts"), F.col("best.tied_by").alias("best"), F.col("best.pivot").alias("best_pivot")), "jaccard-regions-parted")

        def settle(loose: Column, whole: Column, last: bool) -> Column:
            rest = "pairs" if last else "again"
            return F.when(loose == 0, "done").when(whole <= most, "ready").when(loose <= most // 2, "blocks").otherwise(rest)

        last = turn == TURNS - 1
        ways = of.join(per.filter("parts"), F.col("region") == F.col("r")).select(F.col("region").alias("r"), F.col("pivot").alias("p"), "tied_by", whole.alias("w"), settle(loose, whole, last).alias("way"))
        ways = written(ways.filter("way <> 'done'"), "jaccard-ways")
        taken = cells.join(ways, (F.col("region") == F.col("r")) & F.col("pivot").eqNullSafe(F.col("p"))).withColumn("region", F.xxhash64("region", F.coalesce("pivot", F.lit(-1)), F.lit(turn)))
        # a region that cells don't part stays whole, with the pivot that ties most of it
        single = per.filter("not parts").withColumn("way", settle(F.col("m") - F.col("best"), F.col("m"), True)).filter("way <> 'done'")
        single = written(single, "jaccard-single")
        by_best = cells.filter("tied").select(F.col("region").alias("cr"), F.col("pivot").alias("cp"), F.col("tid").alias("ct"))
        kept = todo.join(single, F.col("region") == F.col("r")).join(by_best, (F.col("region") == F.col("cr")) & (F.col("best_pivot") == F.col("cp")) & (F.col("tid") == F.col("ct")), "left")
        columns = [*MEMBER, "pivot", "tied", "tied_by", "w", "way"]
        kept = kept.select(*MEMBER, F.col("best_pivot").alias("pivot"), F.col("ct").isNotNull().alias("tied"), F.col("best").alias("tied_by"), F.col("m").alias("w"), "way")
        both = taken.select(columns).unionByName(kept)
        ready.append(both.filter("way = 'ready'").select(*MEMBER))
        count = F.ceil(F.col("tied_by") / (most // 2)).cast("int")
        where = F.when(F.col("tied") & (F.col("pivot") != F.col("tid")), F.array(F.pmod(F.xxhash64("tid"), count).cast("int"))).otherwise(F.sequence(F.lit(0), count - 1))
        spread = both.filter("way = 'blocks'").withColumn("block", F.explode(where))
        ready.append(spread.withColumn("region", F.xxhash64("region", "block")).select(*MEMBER))
        ready.append(_block_pairs(both.filter("way = 'pairs'").withColumn("m", F.col("w")), most))
        if last or ways.filter("way = 'again'").isEmpty():
            break
        todo = written(taken.filter("way = 'again'").select(*MEMBER), "jaccard-again")
    out, tied = ready[0], links[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    for more in links[1:]:
        tied = tied.unionByName(more)
    return out, tied


def _block_pairs(members: DataFrame, most: int) -> DataFrame:
    """members (with ``m``, the size of their region) as a region for each pair of blocks of their region."""
    blocks = F.ceil(F.col("m") / (most / 2)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    split = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.withColumn("region", F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))).select(*MEMBER)


def _join_regions(regions: DataFrame, sets: DataFrame, like: Likeness, exact: bool, most: int) -> DataFrame:
    """regions (region, tid), sets (tid, n, items array) -> links (a, b): each member with the least it hangs together with.

    A region of more than ``most`` members is parted first.
    """
    counts = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most)
    large = written(counts.select("region"), "jaccard-large")
    members, tied = regions.join(sets, "tid").select(*MEMBER), None
    if not large.isEmpty():
        parts, tied = _parted(written(members.join(large, "region", "left_semi").select(*MEMBER), "jaccard-todo"), like, exact, most)
        members = members.join(large, "region", "left_anti").select(*MEMBER).unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return made

        for rows, arrays in _grouped(batches, "region", exact):
            if len(arrays) < 2:
                continue
            tid, first = np.unique(rows["tid"], return_index=True)
            roots = Region([arrays[i] for i in first], rows["n"][first], like, exact).roots()
            moved = np.flatnonzero(roots != np.arange(len(tid)))
            out.append((tid[roots[moved]], tid[moved]))
            if len(out) >= 4096:
                yield flushed()
        if out:
            yield flushed()

    dealt = members.repartition("region").sortWithinPartitions("region")
    found = dealt.mapInArrow(run, "a long, b long")
    return (found if tied is None else found.unionByName(tied)).distinct()


def _whole_sets(source: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """wanted (tid, t1, t2) -> (tid, n, items): whole sets of the wanted texts alone."""
    bits = source.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                texts, keys, rows = _passing(batch, bits.value)
                if texts:
                    s = Sets(texts, like)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(s.n), s.lists(np.ones(len(s.h), bool), s.h.view(np.int64), pa.int64())],
                        names=["doc_id", "t1", "t2", "n", "items"],
                    )

    sets = source.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, items array<long>")
    return sets.join(wanted.hint("shuffle_hash"), _same_text(sets, wanted)).select("tid", "n", "items")


def jaccard_groups(df: DataFrame, num: int = 90, den: int = 100, width: int = 3, id_col: str = "doc_id", text_col: str = "text", most_members: int = 1024) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links lead to from this row's document.

    A-Z is lower-cased; a text with fewer than ``width`` words is one shingle; one without words has none and is linked
    with nothing, its own component. Rows with equal sets are linked. Null ids are documents like others but never the
    smallest; a component of null ids alone has a null id. Other columns are not read; an empty table gives an empty
    one. Texts are read whole; a task holds a slice of a batch, or a region of at most ``most_members`` documents.
    """
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows, sets, roots = _linked_sets(source, Likeness(num, den, width), most_members)
    named = sets.select("tid", "k1", "k2", "n", "least").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("k1", "k2", F.col("n").alias("_n"), "component_id", F.lit(True).alias("_in"))
    out = rows.select("doc_id", "n", "k1", "k2").join(named, (F.col("n") == F.col("_n")) & rows["k1"].eqNullSafe(named["k1"]) & rows["k2"].eqNullSafe(named["k2"]), "left")
    return out.select(rows["doc_id"].alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(df: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", most_members: int = 1024) -> DataFrame:
    """One row of each group of linked documents, all columns as they are: that of the smallest id (null last, then by
    a hash of the text; of rows equal in both any). Rows without words are linked with nothing and all stay."""
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows, sets, roots = _linked_sets(source, Likeness(num, den, width), most_members)
    named = sets.select("tid", "doc_id", "t1", "t2").join(roots, "tid", "left")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")
    stays = named.groupBy(F.coalesce("root", "tid").alias("root")).agg(F.min(place).alias("s")).select("s.doc_id", "s.t1", "s.t2")
    copies = rows.filter("n > 0").groupBy("doc_id", "t1", "t2").count().filter("count > 1").withColumnRenamed("count", "copies")
    copies = written(copies, "jaccard-copies")
    names = df.columns
    place_of_text = names.index(text_col)
    keyed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], df[id_col].cast("long").alias("doc_id"))
    kinds = ", ".join(f"{c} {t}" for c, t in keyed.dtypes)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="words")
        for whole in batches:
            for batch in byte_slices(whole, f"c{place_of_text}", SLICE):
                texts = texts_of(batch, f"c{place_of_text}")
                keys = _text_keys(texts)
                blank = pa.array([not t.split() for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), blank], names=[*batch.schema.names, "t1", "t2", "blank"])

    keyed = keyed.mapInArrow(key, f"{kinds}, t1 long, t2 long, blank boolean")
    same = lambda a, b: (a["t1"] == b["t1"]) & (a["t2"] == b["t2"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    stays = written(stays.withColumn("_stays", F.lit(True)), "jaccard-stays")
    found = keyed.join(stays.hint("shuffle_hash"), same(keyed, stays), "left").filter(F.col("blank") | F.col("_stays"))
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if copies.isEmpty():
        return found.select(columns)
    found = found.select(*[f"c{i}" for i in range(len(names))], keyed["doc_id"], keyed["t1"], keyed["t2"], "blank")
    often = found.join(copies, same(found, copies), "left_semi").filter("not blank").dropDuplicates(["doc_id", "t1", "t2"])
    return found.join(copies, same(found, copies), "left_anti").select(columns).unionByName(often.select(columns))


def _linked_sets(source: DataFrame, like: Likeness, most_members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the key of their set, distinct sets with one text that stands for each, and (tid, root) of linked sets."""
    rows = written(_read(source, like), "jaccard-rows")
    # one text stands for a set: that of the smallest (id, text key)
    stands = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")).alias("s")
    sets = rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), stands, *[F.first(c).alias(c) for c in ("first", "sketch", "profile")])
    sets = sets.select("k1", "k2", "n", "least", "s.doc_id", "s.t1", "s.t2", "first", "sketch", "profile").withColumn("tid", F.monotonically_increasing_id())
    sets = written(sets, "jaccard-sets")

    firsts = _reordered(source, sets, like)
    regions = written(_regions(firsts, like).select(F.col("pivot").alias("region"), "tid"), "jaccard-regions")
    regions = written(_thinned(regions, sets, like, most_members), "jaccard-thinned")
    near = written(_join_regions(regions, sets.select("tid", "n", F.col("sketch").alias("items")), like, False, most_members), "jaccard-near")
    groups = written(near.unionAll(near.select("a", F.col("a").alias("b"))).distinct().select(F.col("a").alias("region"), F.col("b").alias("tid")), "jaccard-groups")
    wanted = written(sets.join(groups.select("tid").distinct(), "tid", "left_semi").select("tid", "doc_id", "t1", "t2"), "jaccard-wanted")
    links = written(_join_regions(groups, _whole_sets(source, wanted, like), like, True, most_members), "jaccard-links")
    return rows, sets, connected(links).withColumnRenamed("v", "tid")
