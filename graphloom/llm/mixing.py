"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is ``min(cap, level * weight)``. Handing the excess of clamped sources to the others by weight, again
and again, ends at the one ``level`` for which the targets sum to what is asked. Sources that clamp are those with the
lowest cap per weight, so running sums over the sources in that order give the level at once.

A target is so many whole passes over its source and a fraction of one more. The fraction takes documents in the order
of a seeded hash until their sizes reach it. Only the documents at the edge need an order: two rounds of hash buckets
find the bucket in which the edge lies, and one window sorts the few documents of that bucket, so no task ever holds a
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import WORD, written

BUCKETS = 1 << 10


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, weight, size): ``share`` of all sizes dealt by weight, none above max_epochs * size.

    What all caps together can't hold is not dealt: then every source is at its cap. Weights must be above 0.
    """
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = sources.withColumn("_cap", F.col("size") * F.lit(float(max_epochs)))
    s = s.withColumn("_asked", F.sum("size").over(whole) * F.lit(float(share)))
    s = s.withColumn("_rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_asked") - F.col("_before")) / F.col("_rest"))
    # the first source in this order whose cap isn't reached sets the level for all from there on
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("weight")))
    return s.withColumn("target", target).drop("_cap", "_asked", "_rest", "_before", "_level")


def _edge(sizes: DataFrame, quota: DataFrame, bucket: str) -> DataFrame:
    """For each source the bucket in which its fraction ends, and what is left of the fraction at its start."""
    run = Window.partitionBy("_s").orderBy(bucket)
    sums = sizes.groupBy("_s", bucket).agg(F.sum("size").alias("_in"))
    sums = sums.withColumn("_past", F.sum("_in").over(run) - F.col("_in")).join(quota, "_s")
    return (
        sums.filter((F.col("_past") <= F.col("_quota")) & (F.col("_past") + F.col("_in") > F.col("_quota")))
        .groupBy("_s")
        .agg(F.min(bucket).alias("_edge"), F.min(F.col("_quota") - F.col("_past")).alias("_quota"))
    )


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of df, then size, source_size, target and taken (words the mix takes of this row, repeats counted).

    Sources in code-point order, null last and a source of its own, have ``weights`` in turn. Size is the number of
    words, 0 for a null text. ``taken`` is size times the whole passes, once more for documents inside the fraction;
    the one at the edge is inside if half of it is, so a source's sum is within half a document of its target. The
    order is a hash of seed, id, size and source, so reruns agree; repeated rows are separate rows that may be dealt
    with differently. An empty table gives an empty one; documents without words take 0. Source names are few by
    nature; tables of one row for each are written, so Spark knows their size when it picks a join. A column of df named like a result gives way to it.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    results = ("size", "source_size", "target", "taken")
    kept = [c for c in df.columns if c not in results]
    keyed = df.select(
        *[df[c].alias(f"_c{i}") for i, c in enumerate(kept)],
        df[source_col].alias("source"),
        word_count(df[text_col]).alias("size"),
        F.xxhash64(F.lit(seed), df[id_col].cast("string"), df[source_col], F.crc32(F.coalesce(df[text_col].cast("binary"), F.lit(b"")))).alias("_mix_h"),
        F.coalesce(F.concat(F.lit("s"), df[source_col]), F.lit("n")).alias("_s"),
    )
    plan = mix_plan(keyed.select("_s", "source", "size", "_mix_h"), weights, share, max_epochs)
    return keyed.join(plan, "_s").select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("_whole") + _inside(F.col("_mix_h"), F.col("size")).cast("long"))).alias("taken"),
    )


def _first(h: Column) -> Column:
    return F.shiftrightunsigned(h, 54)


def _second(h: Column) -> Column:
    return F.shiftrightunsigned(h, 44) % F.lit(BUCKETS)


def _inside(h: Column, size: Column) -> Column:
    """Whether the fraction takes this row, by its place before, after or in the bucket at the edge."""
    at = F.struct(_first(h), _second(h))
    edge = F.struct(F.col("_edge1"), F.col("_edge2"))
    last = (h < F.col("_last_h")) | ((h == F.col("_last_h")) & F.col("_last_in"))
    return F.when(F.col("_edge1").isNull(), F.col("_all")).when(at < edge, True).when(at > edge, False).otherwise(F.coalesce(last, F.lit(False)))


def mix_plan(sizes: DataFrame, weights, share, max_epochs) -> DataFrame:
    """One row per source: size, target, whole passes, and where in the hash order its fraction ends."""
    sizes = written(sizes, "mix-sizes")
    sources = sizes.groupBy("_s", "source").agg(F.sum("size").alias("size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    targets = source_targets(sources, share, max_epochs)
    passes = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    targets = targets.withColumn("_whole", F.floor(passes + F.lit(1e-12)).cast("long"))
    targets = written(targets.withColumn("_quota", F.greatest(F.col("target") - F.col("_whole") * F.col("size"), F.lit(0.0))), "mix-sources")

    quota = targets.filter("_quota > 0").select("_s", "_quota")
    keyed = sizes.select("_s", "size", "_mix_h", _first(F.col("_mix_h")).alias("_b1"), _second(F.col("_mix_h")).alias("_b2"))
    edge1 = written(_edge(keyed, quota, "_b1").withColumnRenamed("_edge", "_edge1"), "mix-edge")
    in1 = keyed.join(edge1.select("_s", "_edge1"), "_s").filter("_b1 = _edge1")
    edge2 = written(_edge(in1, edge1.select("_s", "_quota"), "_b2").withColumnRenamed("_edge", "_edge2"), "mix-edge")
    in2 = in1.join(edge2, "_s").filter("_b2 = _edge2")
    run = Window.partitionBy("_s").orderBy("_mix_h")
    # rows of one hash (repeats) count as one step, in or out together
    steps = in2.groupBy("_s", "_mix_h", "_quota").agg(F.sum("size").alias("size"))
    steps = steps.withColumn("_past", F.sum("size").over(run) - F.col("size"))
    last = steps.filter("_past <= _quota").groupBy("_s").agg(F.max(F.struct("_mix_h", (F.col("_past") + F.col("size") / 2 <= F.col("_quota")).alias("in"))).alias("_last"))
    ends = edge1.select("_s", "_edge1").join(edge2.select("_s", "_edge2"), "_s", "left").join(last, "_s", "left")
    out = targets.join(ends, "_s", "left").select(
        "_s",
        F.col("size").alias("source_size"),
        "target",
        "_whole",
        F.lit(False).alias("_all"),
        "_edge1",
        F.coalesce("_edge2", F.lit(0)).alias("_edge2"),
        F.col("_last._mix_h").alias("_last_h"),
        F.col("_last.in").alias("_last_in"),
    )
    return written(out, "mix-plan")
