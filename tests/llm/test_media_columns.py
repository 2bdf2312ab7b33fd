import hashlib
import zlib

import numpy as np

from graphloom.llm import queries
from graphloom.llm.media_columns import media_digests, media_pixels, text_media
from graphloom.llm.webp_lossless import encode


def check(rows, texts):
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    order = lambda x: sorted(x, key=repr)
    assert order(tuple(r)[:5] for r in rows) == order(want)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault((r["n_bytes"], r["payload_sha256"]), tuple(r)[5:]) == tuple(r)[5:]


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    check(queries.text_images(spark, d).collect(), [(r["doc_id"], r["text"]) for r in queries.table(spark, d, "documents").collect()])


def test_tricky_rows(spark, tricky):
    check(media_digests(text_media(tricky)).collect(), [(r["doc_id"], r["text"]) for r in tricky.collect()])
    assert media_digests(text_media(tricky.limit(0))).count() == 0


def test_pixels(spark):
    pixels = np.random.default_rng(1).integers(0, 1 << 32, (9, 7), np.uint64).astype(np.uint32)
    good = encode(pixels, predictor=-1, block_bits=2, runs=True, cache_bits=5)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"none")), (4, bytearray(good[:60]))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media_pixels(df).collect()}
    assert got[1]["images"][0]["pixels"] == pixels.ravel().tolist() and (got[1]["images"][0]["width"], got[1]["images"][0]["height"]) == (7, 9)
    assert got[2]["images"] is None and got[2]["problem"] is None
    assert got[3]["images"] is None and got[3]["problem"] and got[4]["problem"]
    told = {r["doc_id"]: r for r in media_digests(df.selectExpr("doc_id", "5L n_bytes", "media")).collect()}
    assert told[1]["payload_bytes"] == 9 * 7 * 4 and told[2]["media_bytes"] is None and told[2]["n_bytes"] == 5
    assert told[3]["media_bytes"] == 4 and told[3]["payload_sha256"] is None and told[4]["payload_sha256"] is None
