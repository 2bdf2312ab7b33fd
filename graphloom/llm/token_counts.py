"""Token counts: Arrow functions that encode in byte-balanced batches and return lengths only.

Long texts are split where no piece of the vocabulary can cross. For a BPE model that writes a space as U+2581, keeps
every space and puts one in front, that is before each run of spaces, if no piece has U+2581 after another character.
Segments repeat a lot, so each distinct one is encoded once per batch and its length kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.shared import byte_slices, makes_room, memo

SPACE = "▁"


class PieceCounter:
    """Lengths of a sentencepiece model's encodings; ``memo_size`` segments and ``batch_bytes`` a batch bound memory."""

    def __init__(self, path: str, memo_size: int = 300_000, batch_bytes: int = 1 << 20):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo: dict[str, int] = {}
        self.memo_size, self.batch_bytes = memo_size, batch_bytes
        self.splits = self._splits(path)

    def _splits(self, path: str) -> bool:
        """Whether encodings may be cut before runs of spaces, read from the model itself."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        user_defined = any(p.type == p.USER_DEFINED for p in model.pieces)
        plain = how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces and not how.precompiled_charsmap
        return bool(plain and not user_defined and not model.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces))

    def _segments(self, text: str) -> list[str]:
        """Keys whose lengths sum to the text's: what the model is given, as it puts one space in front itself."""
        if not self.splits or SPACE in text or "\0" in text:
            return [text]
        parts = text.split(" ")
        if "" not in parts:
            return parts
        keys, blanks = [], 0
        for part in parts:
            if part:
                keys.append(" " * blanks + part)
                blanks = 0
            else:
                blanks += 1
        if blanks and text:
            keys.append(" " * (blanks - 1))  # spaces to the end; the key of a single one is empty
        return keys

    def _learn(self, keys: list[str]) -> None:
        batch: list[str] = []
        size = 0
        for key in keys:
            if batch and size + len(key) > self.batch_bytes:
                self.memo.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))
                batch, size = [], 0
            batch.append(key)
            size += len(key)
        if batch:
            self.memo.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))

    def lengths(self, texts: list[str]) -> list[int]:
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        split = [self._segments(t) if t else None for t in texts]
        keys: set[str] = set()
        for parts in split:
            if parts:
                keys.update(parts)
        self._learn([k for k in keys if k not in self.memo])
        if self.splits:
            self.memo[""] = 1
        count = self.memo.__getitem__
        out = [sum(map(count, parts)) if parts else 0 for parts in split]
        for key in [k for k in keys if len(k) > 256]:  # long keys don't repeat; the memo is bounded in bytes too
            self.memo.pop(key, None)
        return out


_counters: dict[str, PieceCounter] = {}
memo("pieces", _counters.clear)


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens without added tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 of each. Very long texts are counted whole. Repeated rows stay, other columns are not
    read, an empty table gives an empty one. ``model_path`` must be readable on every executor.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes_room(but="pieces")
        counter = _counters.get(model_path) or _counters.setdefault(model_path, PieceCounter(model_path))
        for whole in batches:
            for batch in byte_slices(whole, "text", slice_bytes):
                texts = batch.column("text")
                tokens = counter.lengths([t or "" for t in texts.to_pylist()])
                sizes = pc.binary_length(texts).cast(pa.int64()).fill_null(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
