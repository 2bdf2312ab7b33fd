"""Media columns: texts stored losslessly as WebP images and read back, and features of pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.shared import byte_slices, texts_of
from graphloom.llm.webp_lossless import CorruptImage, load_pixels, samples_of, store_bytes

UNIT = 64
STRIPS = 65


def features(images: list[np.ndarray]) -> str:
    """Number and size of the images, mean and deviation of their samples, and a hash of how brightness runs.

    The hash has a bit for each of 64 neighbours among 65 equal strips of the samples: whether the second is brighter.
    """
    samples = np.concatenate([p.ravel() for p in images]).view(np.uint8)
    sums = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    edges = np.arange(STRIPS + 1) * len(samples) // STRIPS
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    bits = int("".join("01"[int(b)] for b in means[1:] > means[:-1]), 2)
    counts = np.bincount(samples, minlength=256)
    mean = sums[-1] / len(samples)
    spread = max(0.0, int((counts * np.arange(256) ** 2).sum()) / len(samples) - mean**2) ** 0.5
    height, width = images[0].shape
    return f"{len(images)}x{width}x{height} mean={mean:.3f} sd={spread:.3f} run={bits:016x}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8) and media, the text with zeros up to a positive multiple of 64 bytes as WebP.

    A null text is empty: one row of zero samples. Texts of any length are stored whole, in as many images as they
    need. Equal texts have equal media. Repeated rows stay, other columns are not read, an empty table gives an empty one.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 4 << 20):
                texts = texts_of(batch, "text")
                media = [store_bytes(t + bytes(-len(t) % UNIT or (0 if t else UNIT))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_pixels(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row: id, images (arrays of width, height and pixels as 0xAARRGGBB in longs), and problem.

    Null media has null images; media that isn't lossless WebP has null images and says why in ``problem``.
    """
    source = df.select(df[id_col].alias("id"), df[media_col].alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "media", 4 << 20):
                images, problems = [], []
                for media in batch.column("media").to_pylist():
                    try:
                        decoded = None if media is None else load_pixels(media)
                        problems.append(None)
                    except CorruptImage as e:
                        decoded = None
                        problems.append(str(e))
                    images.append(None if decoded is None else [{"width": p.shape[1], "height": p.shape[0], "pixels": p.ravel().astype(np.int64)} for p in decoded])
                kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(images, kind), pa.array(problems, pa.string())], names=[id_col, "images", "problem"])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, images array<struct<width:int,height:int,pixels:array<long>>>, problem string")


def media_digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored media hold: id, n_bytes, and sizes and hashes of the samples read back and of the media itself.

    Null media has nulls in all of them; media that can't be read has its own size and hash and nulls for the rest. Repeated
    rows stay, other columns are not read, an empty table gives an empty one.
    """
    source = df.select(df[id_col].alias("id"), df["n_bytes"].alias("n_bytes"), df[media_col].alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "media", 2 << 20):
                rows = []
                for media in batch.column("media").to_pylist():
                    if media is None:
                        rows.append((None,) * 6)
                        continue
                    stored = len(media), hashlib.sha256(media).hexdigest()
                    try:
                        images = load_pixels(media)
                        payload = b"".join(map(samples_of, images))
                        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, features(images) if images else None))
                    except CorruptImage:
                        rows.append((None, None, None, *stored, None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
