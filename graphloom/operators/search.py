"""Exact text search over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_lines(df: DataFrame, pattern: str, keys: list[str], text_col: str, limit: int) -> DataFrame:
    """Lines that contain the pattern literally, in the order of keys and line number: keys, line_no (from 1), line.

    Texts without the pattern are dropped before they are split, and the cut is a top-k, not a sort of all lines.
    """
    texts = df.filter(F.col(text_col).contains(pattern))
    lines = texts.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).filter(F.col("line").contains(pattern))
    return lines.select(*keys, (F.col("at") + 1).cast("long").alias("line_no"), "line").orderBy(*keys, "line_no").limit(limit)


def containing(texts: DataFrame, text_id: str, text_col: str, passages: DataFrame, passage_id: str, passage_col: str) -> DataFrame:
    """(text_id, passage_id): which texts contain which passages literally, anywhere.

    A passage that has white space around some word is looked up by its longest such word, which every text that
    contains the passage has as a whole word too; the exact test follows. Passages of one or two words have no such
    word and are compared with every text. Null texts and passages contain and are contained in nothing.
    """
    words = F.split(F.col("_p"), r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = passages.select(F.col(passage_id), F.col(passage_col).alias("_p")).filter("_p is not null").withColumn("_w", longest)
    have = texts.select(F.col(text_id), F.col(text_col).alias("_t")).filter("_t is not null")
    keyed = have.select(text_id, F.explode(F.array_distinct(F.split("_t", r"\s+"))).alias("_w"))
    pairs = keyed.join(asked.filter("_w is not null AND _w <> ''").select(passage_id, "_w"), "_w").select(text_id, passage_id)
    exact = pairs.join(have, text_id).join(asked.select(passage_id, "_p"), passage_id).filter(F.col("_t").contains(F.col("_p")))
    short = asked.filter("_w is null OR _w = ''")
    return exact.select(text_id, passage_id).unionByName(have.join(short, F.col("_t").contains(F.col("_p"))).select(text_id, passage_id))
