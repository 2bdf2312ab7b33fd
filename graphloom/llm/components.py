"""Connected components of a table of links, by label passing with shortcuts; no link ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, written


def connected(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (v, root): each linked vertex with the smallest vertex of its component.

    Each round takes the least root among neighbours, then the root's own root, so long chains halve. Each round's
    labels are a table in the shared folder. Nulls, loops and repeated links are ignored.
    """
    links = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("v").alias("r"), F.col("root").alias("further"))
        step = step.join(roots, F.col("root") == F.col("r")).select("v", F.least("root", "further").alias("root"), (F.least("root", "further") != F.col("old")).alias("moved"))
        step = written(step, "labels")
        done = step.filter("moved").isEmpty()
        discard(labels)
        if done:
            discard(both)
            return step.select("v", "root")
        labels = step
