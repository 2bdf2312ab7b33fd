"""Lossless WebP, both ways, in numpy: pixel arrays are (height, width) uint32 values 0xAARRGGBB.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Where an image has one group of prefix codes and no back-references, it finds
all symbols at once: for every bit position it looks up what a pixel starting there would take, which gives each
position's successor, and then walks from the first pixel to the last. The encoder takes any choice of these features;
``store_bytes`` stores arbitrary bytes with those that make the file small, and ``load_bytes`` gets them back.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

LENGTH_CODES, DISTANCE_CODES = 24, 40
#: Fixed values of the format: the order in which the lengths of code-length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances as (left, up), nearest first: -7 to 8 left and 0 to 7 up, without those not yet decoded.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
U32 = np.uint32


class CorruptImage(ValueError):
    """The bytes are not a lossless WebP image."""


# ---- prefix codes ---------------------------------------------------------------------------------------------------


def code_lengths(counts: list[int], longest: int = 15) -> list[int]:
    """Lengths of an optimal prefix code, none above ``longest``; a lone symbol gets length 1."""
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    lengths = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        weights = [max(c, floor) for c, _ in used]
        n = len(weights)
        parent = [0] * (2 * n - 1)
        leaf, node = 0, n
        total = weights + [0] * (n - 1)
        for new in range(n, 2 * n - 1):
            at = 0
            for _ in range(2):
                if node >= new or (leaf < n and total[leaf] <= total[node]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, node = node, node + 1
                parent[pick] = new
                at += total[pick]
            total[new] = at
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= longest:
            for (_, s), d in zip(used, depth):
                lengths[s] = d
            return lengths
        floor = max(2 * floor, used[-1][0] >> longest)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes as the stream has them: first bit lowest."""
    lengths = np.asarray(lengths, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order]
    # each code is the sum of what the shorter and earlier ones take of the code space
    space = np.concatenate([[0], np.cumsum(1 << (15 - own))[:-1]]) if len(own) else own
    flipped = _REVERSED[space]
    out = np.zeros(len(lengths), np.int64)
    out[order] = flipped
    return out


_REVERSED = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _REVERSED |= ((np.arange(1 << 15) >> _bit) & 1) << (14 - _bit)


class Code:
    """A prefix code for reading: by the next ``bits`` bits, a symbol and its length. A lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = lengths.nonzero()[0]
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.size = np.array([self.only], np.int32), np.zeros(1, np.uint8)
            return
        own = lengths[used].astype(np.int64)
        if int((1 << (15 - own)).sum()) != 1 << 15:
            raise CorruptImage("a prefix code isn't complete")
        self.bits, self.only = int(own.max()), None
        order = used[np.argsort(own, kind="stable")]
        spread = np.repeat(order, 1 << (self.bits - lengths[order].astype(np.int64)))
        flip = _REVERSED[: 1 << self.bits] if self.bits == 15 else _REVERSED[np.arange(1 << self.bits)] >> (15 - self.bits)
        self.symbol = spread[flip].astype(np.int32)
        self.size = lengths[self.symbol].astype(np.uint8)


# ---- bits -----------------------------------------------------------------------------------------------------------


class Reader:
    """Bits of data, lowest first, from a position that callers may set."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end + 64:
            raise CorruptImage("the data ends early")
        byte, bit = divmod(self.at, 8)
        self.at += n
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> bit) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        byte, bit = divmod(self.at, 8)
        window = (int.from_bytes(self.data[byte : byte + 3], "little") >> bit) & ((1 << code.bits) - 1)
        self.at += int(code.size[window])
        if self.at > self.end + 64:
            raise CorruptImage("the data ends early")
        return int(code.symbol[window])


class Writer:
    """Collects (value, number of bits) pairs; values have up to 32 bits."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.small: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.small.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def _flush(self) -> None:
        if self.small:
            self.values.append(np.array([v for v, _ in self.small], np.uint64))
            self.sizes.append(np.array([n for _, n in self.small], np.int64))
            self.small = []

    def bytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        end = np.cumsum(sizes)
        at = end - sizes
        moved = values << (at & 31).astype(np.uint64)
        word = at >> 5
        n = int(end[-1] + 31 >> 5) + 1
        # bits of different values never meet, so sums are unions
        low = np.bincount(word, (moved & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (moved >> np.uint64(32)).astype(np.float64), n + 1)[:n]
        return (low + high).astype(np.uint64).astype("<u4").tobytes()[: int(end[-1] + 7 >> 3)]


# ---- reading --------------------------------------------------------------------------------------------------------


def _read_lengths(r: Reader, alphabet: int, before: tuple[int, int, Code] | None) -> tuple[Code, bool]:
    """A prefix code; and whether its reading would be the same for any alphabet that has its symbols."""
    if before is not None:
        start, stop, code = before
        if _same_bits(r, start, stop) and int(np.flatnonzero(code.lengths)[-1]) < alphabet:
            r.at += stop - start
            return code, True
    if r.read(1):
        lengths = np.zeros(max(256, alphabet), np.uint8)
        two, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[r.read(8)] = 1
        return Code(lengths[:alphabet] if not lengths[alphabet:].any() else lengths), True
    outer = np.zeros(19, np.uint8)
    for i in range(4 + r.read(4)):
        outer[LENGTH_ORDER[i]] = r.read(3)
    code = Code(outer)
    counted = r.read(1)
    left = 2 + r.read(2 + 2 * r.read(3)) if counted else alphabet
    lengths, last = [], 8
    symbols, sizes = code.symbol.tolist(), code.size.tolist()
    mask, byte = (1 << code.bits) - 1, r.at >> 3
    window, base = int.from_bytes(r.data[byte : byte + 600], "little") >> (r.at & 7), r.at
    while len(lengths) < alphabet and left:
        left -= 1
        if r.at - base > 4600:
            byte, base = r.at >> 3, r.at
            window = int.from_bytes(r.data[byte : byte + 600], "little") >> (r.at & 7)
        symbol, n = symbols[window & mask], sizes[window & mask]
        window >>= n
        if symbol < 16:
            lengths.append(symbol)
            last = symbol or last
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            lengths += [last if symbol == 16 else 0] * (least + (window & ((1 << extra) - 1)))
            window >>= extra
            n += extra
        r.at += n
    if len(lengths) > alphabet:
        raise CorruptImage("too many code lengths")
    own = bool(counted) and len(lengths) < alphabet
    lengths += [0] * (alphabet - len(lengths))
    return Code(np.array(lengths, np.uint8)), own


def _same_bits(r: Reader, start: int, stop: int) -> bool:
    n = stop - start
    cut = lambda at: (int.from_bytes(r.data[at >> 3 : (at + n + 7 >> 3) + 1], "little") >> (at & 7)) & ((1 << n) - 1)
    return r.at + n <= r.end and cut(start) == cut(r.at)


def _read_group(r: Reader, cache_size: int) -> list[Code]:
    codes, before = [], None
    for alphabet in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES):
        start = r.at
        code, own = _read_lengths(r, alphabet, before)
        before = (start, r.at, code) if own else None
        codes.append(code)
    return codes


def _value(r: Reader, prefix: int) -> int:
    """A length or distance: its prefix code and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise CorruptImage("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    meta, meta_bits, groups = None, 0, 1
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        small = _read_pixels(r, _ceil(width, meta_bits), _ceil(height, meta_bits), False)
        meta = ((small >> U32(8)) & U32(0xFFFF)).astype(np.int64)
        groups = int(meta.max()) + 1
    codes = [_read_group(r, cache_size) for _ in range(groups)]
    first = codes[0][0]
    if meta is None and not first.lengths[256 : 256 + LENGTH_CODES].any() and (first.only is None or first.only < 256):
        return _read_literals(r, codes[0], width * height, cache_bits).reshape(height, width)
    return _read_symbols(r, codes, meta, meta_bits, cache_bits, width, height).reshape(height, width)


def _read_literals(r: Reader, codes: list[Code], pixels: int, cache_bits: int = 0, chunk: int = 1 << 17) -> np.ndarray:
    """Pixels that are all literals or cache hits, found for a chunk of bytes at a time."""
    four = codes[:4]
    if all(c.only is not None for c in four):
        g, red, b, a = (c.only for c in four)
        return np.full(pixels, (a << 24) | (red << 16) | (g << 8) | b, U32)
    widest = max(c.bits for c in four)
    hits = cache_bits > 0 and bool(four[0].lengths[256:].any())
    # channels with equal codes share their lookups
    like = [next(j for j in range(k + 1) if np.array_equal(four[j].lengths, c.lengths) or (not four[j].lengths[256:].any() and np.array_equal(four[j].lengths[:256], c.lengths[:256]))) for k, c in enumerate(four)]
    data = np.frombuffer(r.data, np.uint8)
    out = np.empty((pixels, 4), np.uint8)
    slot = np.full(pixels if hits else 0, -1, np.int32)
    done = 0
    while done < pixels:
        byte = r.at >> 3
        part = data[byte : byte + chunk + 16]
        last = byte + len(part) >= len(data)
        wide = np.zeros(len(part) + 3, np.uint32)
        wide[: len(part)] = part
        wide = wide[:-3] | wide[1:-2] << U32(8) | wide[2:-1] << U32(16)
        window = ((wide[:, None] >> np.arange(8, dtype=U32)) & U32((1 << widest) - 1)).ravel()
        n = len(window)
        sizes: list[np.ndarray] = []
        for k, c in enumerate(four):
            if like[k] < k:
                sizes.append(sizes[like[k]])
                continue
            s = np.zeros(n + 320, np.intp)  # beyond the end a pixel takes no bits
            s[:n] = c.size.take(window & U32((1 << c.bits) - 1) if c.bits < widest else window)
            sizes.append(s)
        place = np.arange(n + 256)
        for k, s in enumerate(sizes):
            place = place + s.take(place)
            if hits and k == 0:
                short, ends = place.copy(), (four[0].symbol >= 256).take(window & U32((1 << four[0].bits) - 1) if four[0].bits < widest else window)
        if hits:
            place[:n] = np.where(ends, short[:n], place[:n])
        place[n:] = np.arange(n, n + 256)
        two = place.take(place)
        four_on = memoryview(two.take(two))  # the walk takes four pixels a step
        stop = n if last else n - 256
        begin, p, left = [], r.at & 7, pixels - done
        push = begin.append
        while p < stop and left > 0:
            push(p)
            p = four_on[p]
            left -= 4
        if not begin:
            raise CorruptImage("the data ends early")
        each = np.array(begin)
        p_of = np.stack([each, place[each], two[each], place[two[each]]], 1).ravel()[: pixels - done]
        if p_of[-1] >= n:
            raise CorruptImage("the data ends early")
        found, following = len(p_of), int(place[p_of[-1]])
        for k, c in enumerate(four):
            symbol = c.symbol.take(window.take(p_of, mode="clip") & U32((1 << c.bits) - 1))
            out[done : done + found, k] = symbol
            if hits and k == 0:
                slot[done : done + found] = symbol - 256 - LENGTH_CODES
            p_of = p_of + sizes[k].take(p_of)
        done += found
        r.at = byte * 8 + following
        if r.at > r.end:
            raise CorruptImage("the data ends early")
    g, red, b, a = (out[:, k].astype(U32) for k in range(4))
    literal = a << U32(24) | red << U32(16) | g << U32(8) | b
    return _from_cache(literal, slot, cache_bits) if hits else literal


def cache_slots(pixels: np.ndarray, bits: int) -> np.ndarray:
    """The place of each pixel in a colour cache."""
    return (((pixels.astype(np.uint64) * np.uint64(HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.uint16)


def _from_cache(pixels: np.ndarray, slot: np.ndarray, bits: int) -> np.ndarray:
    """Pixels with those of a slot of 0 or more replaced by the last pixel before that has this slot (0 if none has)."""
    key = np.where(slot >= 0, slot, cache_slots(pixels, bits)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    key, at = key[order], np.arange(len(key))
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    # a hit puts its own value back, so what counts is the last literal of the slot
    last = np.maximum.accumulate(np.where(slot[order] < 0, at, -1))
    known = last >= np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty_like(pixels)
    out[order] = np.where(known, pixels[order][last], U32(0))
    return out


def _read_symbols(r: Reader, groups: list[list[Code]], meta: np.ndarray | None, meta_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    """Literals, back-references and colour-cache hits, one after the other."""
    out = np.zeros(width * height, U32)
    total, at = len(out), 0
    cache = [0] * (1 << cache_bits)
    cached = 0  # pixels already put into the cache; it is only filled when it is read
    shift = 32 - cache_bits
    values: list[int] = []
    while at < total:
        codes = groups[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])] if meta is not None else groups[0]
        symbol = r.symbol(codes[0])
        if symbol < 256:
            red, blue, alpha = r.symbol(codes[1]), r.symbol(codes[2]), r.symbol(codes[3])
            values.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 256 + LENGTH_CODES:
            length = _value(r, symbol - 256)
            back = _distance(_value(r, r.symbol(codes[4])), width)
            if back > at or at + length > total:
                raise CorruptImage("a back-reference leaves the image")
            if back >= length:
                values += values[at - back : at - back + length]
            else:
                for _ in range(length):
                    values.append(values[-back])
        else:
            for v in values[cached:at]:
                cache[(v * HASH & 0xFFFFFFFF) >> shift] = v
            cached = at
            values.append(cache[symbol - 256 - LENGTH_CODES])
        at = len(values)
    out[:] = values
    return out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of pixels, channel by channel modulo 256."""
    even, odd = U32(0x00FF00FF), U32(0xFF00FF00)
    return ((a & odd) + (b & odd)) & odd | ((a & even) + (b & even)) & even


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _clamped(values) -> int:
    out = 0
    for v in values:
        out = out << 8 | min(255, max(0, v))
    return out


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """The predicted pixel of a mode from its neighbours."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 6:
        return _mean(left, top_left)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(top_left, top)
    if mode == 9:
        return _mean(top, top_right)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:
        corner = _channels(top_left)
        to_left = sum(abs(t - c) for t, c in zip(_channels(top), corner))
        to_top = sum(abs(x - c) for x, c in zip(_channels(left), corner))
        return left if to_left < to_top else top
    if mode == 12:
        return _clamped(x + t - c for x, t, c in zip(_channels(left), _channels(top), _channels(top_left)))
    if mode == 13:
        return _clamped(m + int((m - c) / 2) for m, c in zip(_channels(_mean(left, top)), _channels(top_left)))
    return 0xFF000000


def _sum_pixel(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _undo_predictor(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    modes = (modes >> U32(8) & U32(15)).tolist()
    out = pixels.astype(np.int64).ravel().tolist()  # row by row, so the pixel right of a row's last is the next row's first
    out[0] = _sum_pixel(out[0], 0xFF000000)
    for x in range(1, width):
        out[x] = _sum_pixel(out[x], out[x - 1])
    for y in range(1, height):
        row = modes[y >> bits]
        at = y * width
        out[at] = _sum_pixel(out[at], out[at - width])
        for x in range(1, width):
            i = at + x
            out[i] = _sum_pixel(out[i], predict(row[x >> bits], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1]))
    return np.array(out, U32).reshape(height, width)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & U32(255)).astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, bits: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1, undoing) or takes away (-1) what green and red tell of red and blue."""
    height, width = pixels.shape
    f = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width]
    to_red, green_blue, red_blue = _signed(f), _signed(f >> U32(8)), _signed(f >> U32(16))
    green, red, blue = _signed(pixels >> U32(8)), (pixels >> U32(16) & U32(255)).astype(np.int32), (pixels & U32(255)).astype(np.int32)
    new_red = red + sign * ((to_red * green) >> 5) & 255
    true_red = new_red if sign > 0 else red
    new_blue = blue + sign * (((green_blue * green) >> 5) + ((red_blue * _signed(true_red.astype(U32))) >> 5)) & 255
    return pixels & U32(0xFF00FF00) | new_red.astype(U32) << U32(16) | new_blue.astype(U32)


def _undo_palette(pixels: np.ndarray, table: np.ndarray, width: int, packed: int) -> np.ndarray:
    index = (pixels >> U32(8) & U32(255)).astype(np.int64)
    if packed:
        each = 8 >> packed
        index = (index[:, :, None] >> (np.arange(1 << packed) * each) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, U32)
    full[: len(table)] = table
    return full[index]


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _ceil(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L chunk."""
    r = Reader(data)
    if r.read(8) != 0x2F:
        raise CorruptImage("no lossless image")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise CorruptImage("an unknown version")
    undo, now, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise CorruptImage("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = r.read(3) + 2
            undo.append((kind, bits, _read_pixels(r, _ceil(now, bits), _ceil(height, bits), False), now))
        elif kind == PALETTE:
            size = r.read(8) + 1
            steps = _read_pixels(r, size, 1, False)[0]
            table = np.stack([np.cumsum(steps >> U32(s) & U32(255)).astype(np.uint8).astype(U32) << U32(s) for s in (0, 8, 16, 24)]).sum(0, dtype=U32)
            undo.append((kind, _packing(size), table, now))
            now = _ceil(now, _packing(size))
        else:
            undo.append((kind, 0, None, now))
    pixels = _read_pixels(r, now, height, True)
    for kind, bits, more, wide in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, bits, more)
        elif kind == CROSS_COLOR:
            pixels = _cross(pixels, bits, more, 1)
        elif kind == PALETTE:
            pixels = _undo_palette(pixels, more, wide, bits)
        else:
            green = pixels >> U32(8) & U32(255)
            pixels = _add(pixels, green << U32(16) | green)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a lossless image."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CorruptImage("no WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise CorruptImage("no lossless image")


# ---- writing --------------------------------------------------------------------------------------------------------


def _length_tokens(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths up to the last used symbol as (token, extra bits' value, their number)."""
    end = len(lengths)
    while end and not lengths[end - 1]:
        end -= 1
    out, i, last = [], 0, 8
    while i < end:
        run, own = i + 1, lengths[i]
        while run < end and lengths[run] == own:
            run += 1
        n = run - i
        if lengths[i] == 0 and n >= 3:
            n = min(n, 138)
            out.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[i] and lengths[i] == last and n >= 3:
            n = min(n, 6)
            out.append((16, n - 3, 2))
        else:
            n = 1
            last = lengths[i] or last
            out.append((lengths[i], 0, 0))
        i += n
    return out


def _header(lengths: list[int]) -> list[tuple[int, int]]:
    """A prefix code as bits: the simple form for up to two symbols under 256, else with a code for its lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        wide = int(used[0] > 1)
        out = [(1, 1), (len(used) - 1, 1), (wide, 1), (used[0], 8 if wide else 1)]
        return out + ([(used[1], 8)] if len(used) == 2 else [])
    tokens = _length_tokens(list(lengths))
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    if sum(map(bool, counts)) == 1:
        counts[0 if not counts[0] else 1] = 1  # decoders differ on a code of one symbol; give it a second
    outer = code_lengths(counts, 7)
    n = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if outer[s]) + 1)
    out = [(0, 1), (n - 4, 4), *((outer[LENGTH_ORDER[i]], 3) for i in range(n)), (1, 1)]
    # the number of tokens follows, so zeros to the alphabet's end are left out
    count = max(len(tokens), 2)
    tokens += [(0, 0, 0)] * (count - len(tokens)) if outer[0] else []
    size = max(2, (count - 2).bit_length() + (count - 2).bit_length() % 2)
    out += [((size - 2) // 2, 3), (count - 2, size)]
    codes = codes_of(np.array(outer)).tolist()
    for t, value, extra in tokens:
        out.append((codes[t] | value << outer[t], outer[t] + extra))
    return out


@dataclass(frozen=True)
class Token:
    """A literal pixel (length 0), a run of ``length`` pixels from ``back`` pixels ago, or a cache hit (back -1)."""

    value: int
    length: int = 0
    back: int = 0


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _tokens(pixels: list[int], width: int, cache_bits: int, runs: bool) -> list[Token]:
    """A greedy parse: cache hits, the longest of a few earlier matches of three pixels, literals."""
    out, cache, last, at = [], {}, {}, 0
    near = {_distance(c + 1, width): c + 1 for c in reversed(range(len(NEAR)))}
    shift = 32 - cache_bits

    def put(i: int) -> None:
        if cache_bits:
            cache[(pixels[i] * HASH & 0xFFFFFFFF) >> shift] = pixels[i]
        if runs and i + 2 < len(pixels):
            last[tuple(pixels[i : i + 3])] = i

    while at < len(pixels):
        found = last.get(tuple(pixels[at : at + 3])) if runs else None
        if found is not None and at + 2 < len(pixels):
            n = 3
            while at + n < len(pixels) and n < 4096 and pixels[found + n] == pixels[at + n]:
                n += 1
            back = at - found
            out.append(Token(near.get(back, back + len(NEAR)), n, back))
            for i in range(at, at + n):
                put(i)
            at += n
            continue
        slot = (pixels[at] * HASH & 0xFFFFFFFF) >> shift if cache_bits else 0
        out.append(Token(slot, 0, -1) if cache_bits and cache.get(slot) == pixels[at] else Token(pixels[at]))
        put(at)
        at += 1
    return out


def _write_pixels(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, runs: bool = False, meta_bits: int = 0) -> None:
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    rows: list[list[int]] = []  # the group of codes of each block
    if main:
        w.put(int(meta_bits > 0), 1)
        if meta_bits:
            blocks = _ceil(width, meta_bits), _ceil(height, meta_bits)
            group = (np.arange(blocks[0] * blocks[1]) % 3).reshape(blocks[1], blocks[0])
            w.put(meta_bits - 2, 3)
            _write_pixels(w, (group.astype(U32) << U32(8)) | U32(0xFF000000), False)
            rows = group.tolist()
    tokens = _tokens(flat, width, cache_bits, runs)
    at, placed = 0, []
    for t in tokens:
        placed.append(rows[(at // width) >> meta_bits][(at % width) >> meta_bits] if rows else 0)
        at += t.length or 1
    groups = max((max(r) for r in rows), default=0) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    symbols = []
    for t, g in zip(tokens, placed):
        if t.length:
            (length, lv, ln), (back, bv, bn) = _prefix(t.length), _prefix(t.value)
            symbols.append(((0, 256 + length, lv, ln), (4, back, bv, bn)))
        elif t.back < 0:
            symbols.append(((0, 256 + LENGTH_CODES + t.value, 0, 0),))
        else:
            a, red, green, blue = _channels(t.value)
            symbols.append(((0, green, 0, 0), (1, red, 0, 0), (2, blue, 0, 0), (3, a, 0, 0)))
        for k, s, _, _ in symbols[-1]:
            counts[g][k][s] += 1
    tables = []
    for g in range(groups):
        lengths = [code_lengths(c) for c in counts[g]]
        for n in lengths:
            for value, bits in _header(n):
                w.put(value, bits)
        tables.append([(codes_of(np.array(n)).tolist(), n if sum(map(bool, n)) > 1 else [0] * len(n)) for n in lengths])
    for parts, g in zip(symbols, placed):
        for k, s, value, extra in parts:
            codes, lengths = tables[g][k]
            if lengths[s]:
                w.put(codes[s], lengths[s])
            if extra:
                w.put(value, extra)


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def _start(w: Writer, width: int, height: int) -> None:
    w.put(0x2F, 8)
    w.put(width - 1 | (height - 1) << 14, 28)
    w.put(1, 1)
    w.put(0, 3)


def encode(pixels: np.ndarray, predictor: int | None = None, cross_color: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, runs: bool = False, meta_bits: int = 0, block_bits: int = 3) -> bytes:
    """A WebP file of the pixels, with the features asked for.

    ``predictor`` is a mode for all blocks, or -1 for each block another; ``cross_color`` the three factors (green to
    red, green to blue, red to blue) as signed bytes. ``palette`` needs at most 256 colours.
    """
    pixels = np.ascontiguousarray(pixels, U32)
    height, width = pixels.shape
    if not 0 < width <= 1 << 14 or not 0 < height <= 1 << 14:
        raise ValueError("an image has 1 to 16384 rows and columns")
    w = Writer()
    _start(w, width, height)
    if palette:
        table, index = np.unique(pixels, return_inverse=True)
        if len(table) > 256:
            raise ValueError("more than 256 colours")
        packed = _packing(len(table))
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(table) - 1, 8)
        _write_pixels(w, _steps(table).reshape(1, -1), False)
        index = index.reshape(height, width)
        each = 8 >> packed
        wide = np.zeros((height, _ceil(width, packed) << packed), np.int64)
        wide[:, :width] = index
        joined = (wide.reshape(height, -1, 1 << packed) << (np.arange(1 << packed) * each)).sum(2)
        pixels = joined.astype(U32) << U32(8) | U32(0xFF000000)
        width = pixels.shape[1]
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        red, green, blue = (pixels >> U32(s) & U32(255) for s in (16, 8, 0))
        pixels = pixels & U32(0xFF00FF00) | (red - green & U32(255)) << U32(16) | (blue - green & U32(255))
    shape = _ceil(height, block_bits), _ceil(width, block_bits)
    if predictor is not None:
        modes = np.full(shape, predictor, U32) if predictor >= 0 else (np.arange(shape[0] * shape[1]) % 14).reshape(shape).astype(U32)
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(block_bits - 2, 3)
        _write_pixels(w, modes << U32(8) | U32(0xFF000000), False)
        pixels = _residuals(pixels, block_bits, modes)
    if cross_color is not None:
        to_red, green_blue, red_blue = (f & 255 for f in cross_color)
        factors = np.full(shape, 0xFF000000 | red_blue << 16 | green_blue << 8 | to_red, U32)
        w.put(1, 1)
        w.put(CROSS_COLOR, 2)
        w.put(block_bits - 2, 3)
        _write_pixels(w, factors, False)
        pixels = _cross(pixels, block_bits, factors, -1)
    w.put(0, 1)
    _write_pixels(w, pixels, True, cache_bits, runs, meta_bits)
    return _file(w.bytes())


def _steps(table: np.ndarray) -> np.ndarray:
    """Each colour less the one before, channel by channel."""
    before = np.concatenate([np.zeros(1, U32), table[:-1]])
    return sum(((table >> U32(s)) - (before >> U32(s)) & U32(255)) << U32(s) for s in (0, 8, 16, 24)).astype(U32)


def _residuals(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    flat, modes = pixels.ravel().tolist(), modes.tolist()
    out = []
    for i, p in enumerate(flat):
        y, x = divmod(i, width)
        if not y:
            guess = flat[i - 1] if x else 0xFF000000
        elif not x:
            guess = flat[i - width]
        else:
            guess = predict(modes[y >> bits][x >> bits], flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])
        out.append(_clamped((a - b) & 255 for a, b in zip(_channels(p), _channels(guess))))
    return np.array(out, U32).reshape(height, width)


# ---- bytes as pixels ------------------------------------------------------------------------------------------------

ROW = 16  # pixels, 64 bytes: the width of images with four bytes a pixel
GREY = 64  # pixels: the width of images with one byte a pixel
MOST_ROWS = 1 << 14
LEAST_CACHED = 400  # pixels: what a cache saves in a smaller image, its longer prefix code takes
REPEATED = 0.5  # with fewer distinct windows of 8 bytes than this share of all, bytes are stored with back-references


def store_bytes(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as WebP files end to end of at most 16384 rows of 64 bytes.

    Bytes that repeat themselves are grey pixels, one byte each, with a palette if it lets pixels be packed, and
    back-references. Others are pixels of four bytes (green, red, blue, alpha), with a colour cache where that makes
    the file smaller. The width, 64 or 16, tells which.
    """
    if not payload or len(payload) % (4 * ROW):
        raise ValueError("a positive multiple of 64 bytes is needed")
    step = 4 * ROW * MOST_ROWS
    return b"".join(_store(payload[at : at + step]) for at in range(0, len(payload), step))


def _store(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    if np.count_nonzero(counts) <= 16 or _distinct_windows(samples) < REPEATED:
        return _store_grey(samples, counts)
    return _store_pixels(samples, counts)


def _distinct_windows(samples: np.ndarray) -> float:
    windows = np.lib.stride_tricks.sliding_window_view(samples, 8)
    key = np.ascontiguousarray(windows).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
    short = np.sort((key >> np.uint64(32)).astype(np.uint32))
    return (1 + np.count_nonzero(short[1:] != short[:-1])) / len(short)


def _bits_of(counts: np.ndarray) -> float:
    """About what symbols with these counts take, their code's header included."""
    used = counts[counts > 0].astype(np.float64)
    return float((used * np.log2(used.sum() / used)).sum()) + 4 * len(used) if len(used) else 0.0


def _store_pixels(samples: np.ndarray, counts: np.ndarray) -> bytes:
    w = Writer()
    pixels = len(samples) // 4
    _start(w, ROW, pixels // ROW)
    bits = min(10, pixels.bit_length() - 1)
    cached = pixels >= LEAST_CACHED
    if cached:
        hit, slot = _cache_hits(samples.view("<u4"), bits)
        literal = samples.reshape(-1, 4)[~hit]
        green = np.concatenate([np.bincount(literal[:, 0], minlength=256 + LENGTH_CODES), np.bincount(slot[hit], minlength=1 << bits)])
        rest = np.bincount(literal[:, 1:].ravel(), minlength=256)
        cached = _bits_of(green) + _bits_of(rest) < 0.97 * _bits_of(counts)
    w.put(0, 1)  # no transform
    w.put(int(cached), 1)
    if cached:
        w.put(bits, 4)
    else:
        green = rest = counts
    w.put(0, 1)  # one group of codes
    lengths = [code_lengths(c.tolist()) for c in (green, rest)] if cached else [code_lengths(counts.tolist())] * 2
    headers = [_header(n) for n in (lengths if cached else lengths[:1])]
    w.small += headers[0] + 3 * headers[-1] + _header([1])
    (size, code), (size3, code3) = (_table(n) for n in lengths)
    if not cached:
        value, n = code[samples], size[samples]
        w.put_all(value[::2] | value[1::2] << n[::2], n[::2] + n[1::2])  # two symbols have up to 30 bits
        return _file(w.bytes())
    first = np.where(hit, slot.astype(np.int64) + 256 + LENGTH_CODES, samples[::4])
    values, sizes = np.empty((pixels, 2), np.int64), np.empty((pixels, 2), np.int64)
    red, blue, alpha = (samples[k::4] for k in (1, 2, 3))
    values[:, 0] = code[first] | np.where(hit, 0, code3[red]) << size[first]
    sizes[:, 0] = size[first] + np.where(hit, 0, size3[red])
    values[:, 1] = np.where(hit, 0, code3[blue] | code3[alpha] << size3[blue])
    sizes[:, 1] = np.where(hit, 0, size3[blue] + size3[alpha])
    w.put_all(values.ravel(), sizes.ravel())
    return _file(w.bytes())


def _table(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, code) of each symbol; a lone symbol takes no bits."""
    sizes = np.array(lengths, np.int64)
    return (sizes, codes_of(sizes)) if np.count_nonzero(sizes) > 1 else (np.zeros_like(sizes), np.zeros_like(sizes))


def _cache_hits(quads: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pixels a colour cache has when they come, and every pixel's slot. Bytes lie as green, red, blue, alpha."""
    green, red, blue, alpha = (quads >> U32(8 * k) & U32(255) for k in range(4))
    pixels = alpha << U32(24) | red << U32(16) | green << U32(8) | blue
    slot = cache_slots(pixels, bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return hit, slot


def _store_grey(samples: np.ndarray, counts: np.ndarray) -> bytes:
    w = Writer()
    _start(w, GREY, len(samples) // GREY)
    used = np.flatnonzero(counts)
    green, width = samples, GREY
    if len(used) <= 16:
        packed = _packing(len(used))
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(used) - 1, 8)
        _write_pixels(w, _steps(used.astype(U32) << U32(8) | U32(0xFF000000)).reshape(1, -1), False)
        rank = np.zeros(256, np.int64)
        rank[used] = np.arange(len(used))
        green = (rank[samples].reshape(-1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))).sum(1).astype(np.uint8)
        width = GREY >> packed
    w.put(0, 1)
    w.put(0, 2)  # no cache, one group
    near = {_distance(c + 1, width): c + 1 for c in reversed(range(len(NEAR)))}
    steps = []  # (symbol, length's extra bits, their number, distance's prefix, its extra bits, their number)
    for at, length, back in _matches(green.tobytes()):
        if not length:
            steps += [(g, 0, 0, -1, 0, 0) for g in green[at:back].tolist()]  # literals from at to back
        else:
            (a, av, an), (b, bv, bn) = _prefix(length), _prefix(near.get(back, back + len(NEAR)))
            steps.append((256 + a, av, an, b, bv, bn))
    t = np.array(steps, np.int64)
    far = t[:, 3] >= 0
    lengths = [code_lengths(np.bincount(t[:, 0], minlength=256 + LENGTH_CODES).tolist()), code_lengths(np.bincount(t[far, 3], minlength=DISTANCE_CODES).tolist())]
    w.small += _header(lengths[0])
    for value in (0, 0, 255):
        w.small += _header([int(s == value) for s in range(256)])
    w.small += _header(lengths[1])
    (size, code), (size_d, code_d) = (_table(n) for n in lengths)
    d = np.where(far, t[:, 3], 0)
    values = np.stack([code[t[:, 0]] | t[:, 1] << size[t[:, 0]], np.where(far, code_d[d], 0), t[:, 4]], 1)
    sizes = np.stack([size[t[:, 0]] + t[:, 2], np.where(far, size_d[d], 0), t[:, 5]], 1)
    w.put_all(values.ravel(), sizes.ravel())
    return _file(w.bytes())


def _matches(data: bytes, least: int = 8, most: int = 4096):
    """A greedy parse: (at, 0, end) of literals and (at, length, back) of the latest match of ``least`` bytes or more."""
    n = len(data)
    before = np.full(n, -1)
    if n >= least:
        key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), least)).view(f"<u{least}").ravel()
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
    starts = np.flatnonzero(before >= 0)
    following = starts[np.minimum(np.searchsorted(starts, np.arange(n)), len(starts) - 1)] if len(starts) else np.full(n, -1)
    at = 0
    while at < n:
        begin = int(following[at])
        if begin < at:
            yield at, 0, n
            return
        if begin > at:
            yield at, 0, begin
        source, length = int(before[begin]), least
        while length < most and begin + length < n and data[source + length : source + length + 64] == data[begin + length : begin + length + 64]:
            length += 64
        end = min(n - begin, most)
        length = min(length, end)
        while length < end and data[source + length] == data[begin + length]:
            length += 1
        yield begin, length, begin - source
        at = begin + length


def load_pixels(media: bytes) -> list[np.ndarray]:
    """The images of files end to end."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0] if at + 8 <= len(media) else 0
        if size < 20:
            raise CorruptImage("no WebP file")
        out.append(decode(media[at : at + size]))
        at += size
    return out


def samples_of(pixels: np.ndarray) -> bytes:
    """The bytes that ``store_bytes`` put into an image."""
    flat = pixels.ravel()
    if pixels.shape[1] == GREY:
        return (flat >> U32(8)).astype(np.uint8).tobytes()
    out = np.empty((len(flat), 4), np.uint8)
    for k, shift in enumerate((8, 16, 0, 24)):
        out[:, k] = flat >> U32(shift)
    return out.tobytes()


def load_bytes(media: bytes) -> bytes:
    return b"".join(map(samples_of, load_pixels(media)))
