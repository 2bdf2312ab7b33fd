import itertools
import os
import random
import time

import numpy as np
import pytest

from graphloom.llm import webp_lossless as W


def image(rng, height, width, kind):
    if kind == "noise":
        return rng.integers(0, 1 << 32, (height, width), np.uint64).astype(np.uint32)
    if kind == "few":
        return rng.choice(rng.integers(0, 1 << 32, 7, np.uint64), (height, width)).astype(np.uint32)
    if kind == "flat":
        return np.full((height, width), 0x80FF0001, np.uint32)
    y, x = np.mgrid[:height, :width]
    return (0xFF000000 + (x * 3 % 256 << 16) + (y * 5 % 256 << 8) + (x + y) % 256).astype(np.uint32)


FEATURES = [
    {},
    {"runs": True},
    {"cache_bits": 1},
    {"cache_bits": 11, "runs": True},
    {"meta_bits": 2},
    {"meta_bits": 3, "runs": True, "cache_bits": 6},
    {"subtract_green": True},
    {"cross_color": (30, -77, 127)},
    {"predictor": -1, "block_bits": 2},
    {"predictor": 11, "cross_color": (-128, 1, -3), "subtract_green": True, "runs": True, "cache_bits": 4},
    *({"predictor": m} for m in range(14)),
]


@pytest.mark.parametrize("features", FEATURES, ids=str)
def test_round_trip(features):
    rng = np.random.default_rng(1)
    for (h, w), kind in itertools.product([(1, 1), (1, 9), (13, 1), (17, 23), (40, 33)], ["noise", "few", "flat", "slope"]):
        pixels = image(rng, h, w, kind)
        assert (W.decode(W.encode(pixels, **features)) == pixels).all(), (h, w, kind)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 1 << 32, colours, np.uint64).astype(np.uint32)
    for h, w in [(1, 1), (5, 7), (30, 29)]:
        pixels = rng.choice(table, (h, w))
        for more in ({}, {"runs": True, "cache_bits": 3}, {"predictor": 1}):
            assert (W.decode(W.encode(pixels, palette=True, **more)) == pixels).all()


def test_near_distances():
    assert len(W.NEAR) == 120 and W.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and W.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]
    for v in range(1, 5000):
        p, value, extra = W._prefix(v)
        r = W.Reader(value.to_bytes(8, "little"))
        assert W._value(r, p) == v and r.at == extra


def test_code_lengths_are_complete():
    rng = random.Random(2)
    for longest in (7, 15):
        for _ in range(200):
            counts = [int(1.7 ** rng.randrange(40)) if rng.random() < 0.6 else 0 for _ in range(19)]
            lengths = W.code_lengths(counts, longest)
            used = [n for n in lengths if n]
            assert max(used, default=0) <= longest and [bool(c) for c in counts] == [bool(n) for n in lengths]
            assert len(used) < 2 or sum(2.0**-n for n in used) == 1


def test_bytes():
    rng = np.random.default_rng(3)
    some = [b"\0" * 64, b"ab" * 32, bytes(range(256)), os.urandom(64 * 700), ("Größe und Maß " * 90_000).encode() + b"\0" * 64]
    some += [rng.choice(np.frombuffer(b"etaoin shrdlu\n", np.uint8), 64 * int(n)).tobytes() for n in rng.integers(1, 200, 30)]
    for payload in some:
        payload = payload[: len(payload) // 64 * 64]
        assert W.load_bytes(W.store_bytes(payload)) == payload


def test_speed_of_the_walk():
    payload = ("the quick brown fox jumps over the lazy dog and runs away " * 20_000).encode()
    payload = payload[: len(payload) // 64 * 64]
    media = W.store_bytes(payload)
    start = time.process_time()
    assert W.load_bytes(media) == payload
    assert len(media) < 0.6 * len(payload) and time.process_time() - start < 5


def test_what_is_stored_how():
    """Bytes of each sort come back, and the features meant for them are in the file."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=rng.randrange(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words[:9]) if rng.random() < 0.3 else "".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=rng.randrange(2, 9))) for _ in range(9000)).encode()
    line = " ".join(rng.sample(words, 20)).encode() + b"\n"
    for raw, width, feature in ((prose, W.ROW, "cache"), (line * 300 + prose[:2000], W.GREY, "runs"), (b"ok no " * 500, W.GREY, "palette"), (bytes(64), W.GREY, "palette")):
        payload = raw + bytes(-len(raw) % 64)
        media = W.store_bytes(payload)
        assert W.load_bytes(media) == payload and W.load_pixels(media)[0].shape[1] == width
        r = W.Reader(media[20:])
        r.at = 40
        transform = r.read(1)
        assert transform == int(feature == "palette")
        if feature != "palette":
            assert r.read(1) == int(feature == "cache")
        assert len(media) < (0.65 if feature == "cache" else 0.2) * len(payload) + 60


def test_cache_hits_found_at_once_or_one_by_one():
    rng = np.random.default_rng(6)
    few = rng.integers(0, 1 << 32, 50, np.uint64).astype(np.uint32)
    for bits in (1, 4, 10):
        for size in (3, 40, 3000):
            pixels = np.where(rng.random((size, 16)) < 0.7, rng.choice(few, (size, 16)), rng.integers(0, 1 << 32, (size, 16), np.uint64).astype(np.uint32))
            media = W.encode(pixels, cache_bits=bits)
            assert (W.decode(media) == pixels).all()
            codes_of_one = W._read_literals
            try:  # the same file by the reader that takes one symbol after the other
                W._read_literals = lambda r, codes, n, cache_bits=0: W._read_symbols(r, [codes], None, 0, cache_bits, n, 1)
                assert (W.decode(media) == pixels).all()
            finally:
                W._read_literals = codes_of_one


def test_a_file_of_another_program():
    """The smallest lossless file browsers are probed with: one pixel."""
    import base64

    assert W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)


def test_corrupt():
    good = W.encode(image(np.random.default_rng(4), 20, 20, "noise"))
    for bad in (b"", good[:30], b"RIFF" + good[4:20], good[:4] + b"xxxx" + b"WEBX" + good[12:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(W.CorruptImage):
            W.decode(bad)
