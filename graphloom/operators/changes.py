"""Snapshots, reuse and merges: what changed, what can be kept, and which of several versions wins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, changed, deleted or unchanged, by one full outer join."""
    a = before.select(F.col(key).alias("_a"), F.col(digest).alias("_old"))
    b = after.select(F.col(key).alias("_b"), F.col(digest).alias("_new"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged_edges(rows: DataFrame) -> DataFrame:
    """Edges upserted by (kind, from_id, to_id): the last scalar (by seq) wins, evidence arrays are united and sorted."""
    union = F.array_sort(F.collect_set("_each"))  # a set per edge holds at most the kinds of evidence there are; nulls aren't collected
    each = rows.withColumn("_each", F.explode_outer("evidence"))
    return each.groupBy("kind", "from_id", "to_id").agg(F.max_by("origin", "seq").alias("origin"), F.max_by("confidence", "seq").alias("confidence"), union.alias("evidence"))


def reuse(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, reused): each distinct input once, and whether the cache has it."""
    have = cache.select(F.col(key).alias("_k")).distinct()
    return wanted.select(key).distinct().join(have, F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("reused"))


def greedy_bins(df: DataFrame, group: str, order: str, cost: str, most_cost: int, most_files: int) -> DataFrame:
    """A bin number per row: rows of a group in order fill a bin until cost or number would pass the ceiling.

    The ceilings start anew with each bin, so this is a sequential fold within a group.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        bins, bin_, total, n = [], 0, 0, 0
        for c in g[cost].tolist():
            if n and (total + c > most_cost or n >= most_files):
                bin_, total, n = bin_ + 1, 0, 0
            total, n = total + c, n + 1
            bins.append(bin_)
        return g.assign(bin=bins)[[group, order, cost, "bin"]]

    kinds = dict(df.dtypes)
    return df.select(group, order, cost).groupBy(group).applyInPandas(fold, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, `{cost}` {kinds[cost]}, bin long")


def padded_batches(df: DataFrame, group: str, key: str, size: str, most: int, most_total: int, most_padded: int) -> DataFrame:
    """A batch number per row: rows of a group by size fill a batch under ceilings on number, total and padded total."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([size, key], kind="stable")
        out, batch, n, total = [], 0, 0, 0
        for s in g[size].tolist():
            if n and (n >= most or total + s > most_total or s * (n + 1) > most_padded):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return g.assign(batch=out)[[group, key, size, "batch"]]

    kinds = dict(df.dtypes)
    return df.select(group, key, size).groupBy(group).applyInPandas(fold, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, `{size}` {kinds[size]}, batch long")
