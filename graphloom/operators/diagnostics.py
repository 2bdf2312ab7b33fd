"""What became of files and symbols, and the state of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.symbols import flag

DIAGNOSABLE = ("Function", "Class", "Interface", "TypeAlias", "Symbol", "Test", "Chunk")


def lifecycles(files: DataFrame, facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, status, reason, n_facts, n_nodes, n_edges): how far each file came: skipped, discovered, parsed or indexed."""
    count = lambda df, key, name: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("path")).agg(F.count(F.lit(1)).alias(name))
    rows = files.select("path", "package_name", "reason")
    for df, key, name in ((facts, "path", "n_facts"), (nodes, "file", "n_nodes"), (edges, "owner_file", "n_edges")):
        rows = rows.join(count(df, key, name), "path", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "n_nodes", "n_edges")]
    status = F.when(F.col("reason") != "included", "skipped").when(F.coalesce("n_nodes", F.lit(0)) > 0, "indexed").when(F.coalesce("n_facts", F.lit(0)) > 0, "parsed").otherwise("discovered")
    return rows.select("path", "package_name", status.alias("status"), "reason", *zero)


def diagnose_file(told: DataFrame, asked: str) -> DataFrame:
    """The file asked for, by its path or the end of it; below a folder that was left out, a row made from that folder's reason."""
    query = asked.replace("\\", "/").removeprefix("./").lstrip("/")
    exact = told.filter((F.col("path") == query) | F.col("path").endswith("/" + query)).withColumn("_rank", F.when(F.col("path") == query, 0).otherwise(1))
    folder = F.lit(query).startswith(F.concat(F.col("path"), F.lit("/")))
    above = told.filter((F.col("status") == "skipped") & folder).withColumn("_rank", F.lit(2) - F.length("path") / 10_000).withColumn("path", F.lit(query))
    return exact.withColumn("_rank", F.col("_rank").cast("double")).unionByName(above).orderBy("_rank", "path").limit(1).drop("_rank")


def diagnose_symbol(nodes: DataFrame, told: DataFrame, asked: str) -> DataFrame:
    """Symbols of a name or qualified name, definitions first, with what became of their files."""
    lower = asked.lower()
    found = nodes.filter(F.col("kind").isin(*DIAGNOSABLE) & ((F.lower("name") == lower) | F.coalesce(F.lower("qualified_name") == lower, F.lit(False))))
    rank = F.when(F.col("kind").isin("Function", "Class", "Interface", "TypeAlias"), 0).when(F.col("name") == asked, 1).otherwise(2)
    state = told.select(F.col("path").alias("file"), "status", "reason")
    return found.select("id", "name", "kind", "file", rank.alias("rank")).join(state, "file", "left").orderBy("rank", F.coalesce("file", F.lit("")), "id").select("id", "name", "kind", "file", "status", "reason")


def summary(told: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files by state, edges by how sure they are, files without edges."""
    files = told.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("skipped", "discovered", "parsed", "indexed")], F.count_if((F.col("status") == "indexed") & (F.col("n_edges") == 0)).alias("without_edges"))
    sure = edges.agg(F.count(F.lit(1)).alias("edges"), *[F.coalesce(F.sum(flag(F.col("confidence") == c, 1)), F.lit(0)).alias(c) for c in ("high", "medium", "fallback")])
    return files.crossJoin(sure)  # one row each


def index_status(store, records) -> dict:
    """Whether a graph is published, its manifest, the last progress and the state of the write lock."""
    name = store.active()
    manifest = store.manifest(name) if name else None
    return {"indexed": manifest is not None, "root": store.root, "manifest": manifest, "progress": records.progress(), "write_lock": records.lock_state()}
