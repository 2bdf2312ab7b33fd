"""Embedding inputs of source chunks: header and text, token counts, and splitting under a token budget.

Splitting follows a chunk line by line, so it is one Arrow pass over the chunks that are too long; all others never
leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokens

BUDGET = 512
HEADER = (("repo", "repo"), ("package", "package_name"), ("path", "file")), (("qualifiedName", "qualified_name"), ("kind", "kind"), ("exported", "exported"), ("test", "test"), ("sourceRoot", "source_root"))
_ENDS = re.compile(r"(?:[;{}]|\],?|\),?)\s*$")
_HUMP, _WORD = re.compile(r"([a-z])([A-Z])"), re.compile(r"[a-z0-9_]+")


def count_tokens(text: Column) -> Column:
    """Tokens of an input for the hashed embedding, which has no vocabulary of its own."""
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def count(text: str) -> int:
    """The same for one string."""
    return len(_WORD.findall(_HUMP.sub(r"\1 \2", text).lower()))


def header(columns: list[str], semantic: bool) -> Column:
    """What stands before a chunk's text: its name, or two lines of named fields (those it has)."""
    if not semantic:
        return F.coalesce("name", F.lit("chunk"))
    lines = []
    for fields in HEADER:
        told = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}="), F.col(c).cast("string"))) for label, c in fields if c in columns]
        lines.append(F.concat_ws(" ", *told) if told else F.lit(""))
    return F.array_join(F.filter(F.array(*lines), lambda line: line != ""), "\n")


def embedding_input(columns: list[str], semantic: bool = False) -> Column:
    return F.concat(header(columns, semantic), F.lit("\n"), F.coalesce("content", F.lit("")))


def pieces(text: str, fixed: int, budget: int) -> list[tuple[int, int, int, int, str, int]]:
    """(first line, last line, first column, end column, text, tokens) of each piece; lines count from 0, a piece's
    tokens include ``fixed`` ones of its header.

    A piece takes as many lines as the budget allows and then, if more than one, goes back to the last line that ends a
    statement. A line that is too long by itself is cut where the budget ends, at one character at least.
    """
    lines = re.split(r"\r?\n", text)
    sums = [0, *accumulate(count(line) for line in lines)]
    out, start = [], 0
    while start < len(lines):
        end = bisect_right(sums, sums[start] + budget - fixed, lo=start) - 1
        if end <= start:
            line, at = lines[start], 0
            while at < len(line):
                low, high = at + 1, len(line)
                while low < high:  # the longest part within the budget
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if fixed + count(line[at:mid]) <= budget else (low, mid - 1)
                out.append((start, start, at, low, line[at:low], fixed + count(line[at:low])))
                at = low
            start += 1
            continue
        cut = next((e for e in range(end, start + 1, -1) if _ENDS.search(lines[e - 1])), end)
        body = "\n".join(lines[start:cut])
        out.append((start, cut - 1, 0, len(lines[cut - 1]), body, fixed + sums[cut] - sums[start]))
        start = cut
    return out


def split_chunks(chunks: DataFrame, budget: int = BUDGET, semantic: bool = False) -> DataFrame:
    """chunks (id, name, kind, content, start_line, and header fields) -> the same columns with end_line, tokens,
    oversized, split_from, part and total, a row per piece.

    A chunk within the budget is one row. Pieces are named ``<name> part n`` with ids ``<id>:part-n``; all but the first
    are of kind Chunk. Null content is empty; an empty table gives an empty one.
    """
    names = chunks.columns
    told = chunks.withColumn("_h", header(names, semantic)).withColumn("tokens", count_tokens(F.concat("_h", F.lit("\n"), F.coalesce("content", F.lit("")))))
    lines = F.size(F.split(F.coalesce("content", F.lit("")), "\r?\n"))
    more = {"end_line": F.col("start_line") + lines - 1, "oversized": F.lit(False), "split_from": F.lit(None).cast("string"), "part": F.lit(None).cast("int"), "total": F.lit(None).cast("int")}
    fits = told.filter(F.col("tokens") <= budget).withColumns(more).drop("_h")
    kinds = dict(told.dtypes)
    shape = [*names, "tokens", "end_line", "oversized", "split_from", "part", "total"]
    types = {**{c: kinds[c] for c in names}, "tokens": "int", "end_line": kinds["start_line"], "oversized": "boolean", "split_from": "string", "part": "int", "total": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = pieces(row["content"] or "", count(row.pop("_h")), budget)
                row.pop("tokens")
                for k, (a, b, _, _, text, n) in enumerate(found, 1):
                    whole = len(found) == 1
                    rows.append({
                        **row, "content": text, "tokens": n, "oversized": n > budget, "start_line": row["start_line"] + a, "end_line": row["start_line"] + b,
                        "split_from": None if whole else row["id"], "part": None if whole else k, "total": None if whole else len(found),
                        "id": row["id"] if whole else f"{row['id']}:part-{k}", "name": row["name"] if whole else f"{row['name']} part {k}", "kind": row["kind"] if k == 1 else "Chunk",
                    })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, _ARROW[types[c]]) for c in shape]))

    long = told.filter(F.col("tokens") > budget).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in shape))
    return fits.select(shape).unionByName(long)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
