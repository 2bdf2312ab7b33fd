"""Vectors: hashed bag-of-token embeddings and exact cosine ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a, tokens

DIM = 64


def unit(vector: Column) -> Column:
    """The vector over its length, which is computed once a row; a zero vector as it is."""
    over = lambda squares: F.when(squares > 0, F.transform(vector, lambda x: x / F.sqrt(squares))).otherwise(vector)
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x, over)


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """id and a unit vector that counts each token in the bucket of its hash.

    Counting is a grouped aggregate over (id, bucket), with map-side sums; ids without tokens have a zero vector.
    """
    ids = df.select(F.col(id_col).alias("_i"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    counts = ids.select("_i", F.explode("_t").alias("t")).groupBy("_i", "t").count()
    counts = counts.groupBy("_i", (fnv1a(F.col("t")) % dim).cast("int").alias("b")).agg(F.sum("count").alias("n"))
    # one bucket at most from each group, so the norm is an aggregate and a bucket's value a sum over one row
    sums = [F.sum(F.when(F.col("b") == k, F.col("n"))).cast("double").alias(f"_v{k}") for k in range(dim)]
    filled = counts.groupBy("_i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_len"), *sums)
    vector = F.array(*[F.coalesce(F.col(f"_v{k}") / F.col("_len"), F.lit(0.0)) for k in range(dim)])
    return ids.select("_i").join(filled, "_i", "left").select(F.col("_i").alias(id_col), vector.alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: Column, limit: int, keep: Column | None = None) -> DataFrame:
    """The ``limit`` rows closest to a literal query vector; filters apply before the ranking, so it is exact."""
    rows = vectors if keep is None else vectors.filter(keep)
    scored = rows.withColumn("similarity", cosine(F.col("embedding"), query))
    return scored.orderBy(F.round("similarity", 9).desc(), "vec_id").limit(limit)
