"""A typed property graph over relational tables: nodes with one envelope for all kinds, edges with evidence.

Nodes: id, kind, repo, package_name, file, name, file_kind, symbol_kind, qualified_name, exported, origin, content.
Edges: kind, from_id, to_id, repo, origin, confidence, evidence (sorted distinct array), owner_file.
Every view is a projection or one join of its tables, so filters on kind prune whole branches of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ["id", "kind", "repo", "package_name", "file", "name", "file_kind", "symbol_kind", "qualified_name", "exported", "origin", "content"]
EDGE_COLUMNS = ["kind", "from_id", "to_id", "repo", "origin", "confidence", "evidence", "owner_file"]
#: What each return flag stands for as evidence of a call.
EVIDENCE = {"A": "call-syntax", "N": "compiler", "R": "module-resolution"}


class Tables:
    """The tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def file_path(nation: str, customer: str) -> Column:
    return F.concat(F.lit("n"), F.col(nation).cast("string"), F.lit("/c"), F.col(customer).cast("string"), F.lit(".ts"))


def _shaped(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    out = []
    for name in NODE_COLUMNS:
        value = columns.get(name)
        kind = "boolean" if name == "exported" else "string"
        value = F.lit(value) if value is None or isinstance(value, str) else value
        out.append(value.cast(kind).alias(name))
    return df.select(out)


def nodes(t: Tables, *kinds: str) -> DataFrame:
    """Nodes of the given kinds, or of all."""
    repo = lambda key: F.concat(F.lit("r"), F.col(key).cast("string"))
    made = {
        "Repo": lambda: _shaped(t.region, id=node_id("repo", "r_regionkey"), kind="Repo", repo=repo("r_regionkey"), name=F.col("r_name")),
        "Package": lambda: _shaped(t.nation, id=node_id("package", "n_nationkey"), kind="Package", repo=repo("n_regionkey"), package_name=F.col("n_name"), name=F.col("n_name")),
        "File": lambda: _shaped(_customers(t), id=node_id("file", "c_custkey"), kind="File", repo=repo("n_regionkey"), package_name=F.col("n_name"), file=F.col("file"), name=F.col("c_name"), file_kind=F.col("file_kind")),
        "Function": lambda: _shaped(
            t.orders.join(_customers(t), F.col("o_custkey") == F.col("c_custkey")),
            id=node_id("function", "o_orderkey"),
            kind="Function",
            repo=repo("n_regionkey"),
            package_name=F.col("n_name"),
            file=F.col("file"),
            name=F.concat(F.lit("handle"), (F.col("o_orderkey") % 977).cast("string")),
            file_kind=F.col("file_kind"),
            symbol_kind="Function",
            qualified_name=F.concat(F.col("o_orderstatus"), F.lit(".handle"), (F.col("o_orderkey") % 977).cast("string")),
            exported=F.col("o_orderkey") % 3 == 0,
            origin=F.when(F.col("o_orderkey") % 2 == 0, "compiler").otherwise("syntax"),
        ),
        "Class": lambda: _shaped(
            t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")),
            id=node_id("class", "s_suppkey"),
            kind="Class",
            repo=repo("n_regionkey"),
            package_name=F.col("n_name"),
            file=F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")),
            name=F.col("s_name"),
            file_kind="source",
            symbol_kind="Class",
            qualified_name=F.concat(F.col("n_name"), F.lit("."), F.col("s_name")),
            exported=F.lit(True),
            origin="compiler",
        ),
        "TypeAlias": lambda: _shaped(t.part, id=node_id("type", "p_partkey"), kind="TypeAlias", file=F.concat(F.lit("types/"), F.col("p_brand"), F.lit(".ts")), name=F.col("p_name"), file_kind="source", symbol_kind="TypeAlias", qualified_name=F.concat(F.col("p_type"), F.lit("."), F.col("p_name")), exported=F.col("p_size") > 25, origin="syntax"),
        "Chunk": lambda: _shaped(t.documents, id=node_id("chunk", "doc_id"), kind="Chunk", file=F.concat(F.lit("docs/"), F.col("source"), F.lit(".md")), name=F.concat(F.lit("chunk"), F.col("doc_id").cast("string")), file_kind="source", content=F.col("text")),
    }
    out = None
    for kind in kinds or made:
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out


def _customers(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_name", "n_name", "n_regionkey", file_path("c_nationkey", "c_custkey").alias("file"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("source").alias("file_kind"))


def edges(t: Tables, *kinds: str, of: DataFrame | None = None) -> DataFrame:
    """Edges of the given kinds, or of all; one for each (kind, from, to).

    With ``of`` (from_id; few rows) only edges from these: calls and references then read no more than their lines.
    """
    none = F.array().cast("array<string>")

    def plain(df: DataFrame, kind: str, a: Column, b: Column, repo: Column | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), (repo if repo is not None else F.lit(None).cast("string")).alias("repo"), F.lit("syntax").alias("origin"), F.lit(None).cast("string").alias("confidence"), none.alias("evidence"), F.lit(None).cast("string").alias("owner_file"))

    made = {
        "CONTAINS": lambda: plain(t.nation, "CONTAINS", node_id("repo", "n_regionkey"), node_id("package", "n_nationkey")).unionByName(plain(t.customer, "CONTAINS", node_id("package", "c_nationkey"), node_id("file", "c_custkey"))),
        "DEFINES": lambda: plain(t.orders, "DEFINES", node_id("file", "o_custkey"), node_id("function", "o_orderkey")),
        "CALLS": lambda: _lines(t, "CALLS", "l_suppkey", "class", of),
        "REFERENCES": lambda: _lines(t, "REFERENCES", "l_partkey", "type", of),
        "DEPENDS_ON": lambda: _depends(t, plain),
        "HAS_CHUNK": lambda: plain(t.documents, "HAS_CHUNK", F.concat(F.lit("source:"), F.col("source")), node_id("chunk", "doc_id")),
    }
    out = None
    for kind in kinds or made:
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out if of is None else out.join(F.broadcast(of.select("from_id").distinct()), "from_id", "left_semi").select(EDGE_COLUMNS)


def _lines(t: Tables, kind: str, key: str, target: str, of: DataFrame | None = None) -> DataFrame:
    """One edge per order and ``key`` with the evidence of all its lines; the order's priority gives the confidence."""
    flag = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    lines, orders = t.lineitem, t.orders
    if of is not None:
        few = F.broadcast(of.select("from_id").distinct())
        lines, orders = (rows.join(few, node_id("function", k) == F.col("from_id"), "left_semi") for rows, k in ((lines, "l_orderkey"), (orders, "o_orderkey")))
    merged = lines.groupBy("l_orderkey", key).agg(F.array_sort(F.collect_set(flag[F.col("l_returnflag")])).alias("evidence"))
    orders = orders.select("o_orderkey", "o_custkey", confidence(F.col("o_orderpriority")).alias("confidence"))
    files = t.customer.select("c_custkey", file_path("c_nationkey", "c_custkey").alias("owner_file"))
    joined = merged.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(files, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.lit(kind).alias("kind"), node_id("function", "l_orderkey").alias("from_id"), node_id(target, key).alias("to_id"), F.lit(None).cast("string").alias("repo"), F.lit("resolver").alias("origin"), "confidence", "evidence", "owner_file")


def out_degrees(t: Tables) -> DataFrame:
    """(from_id, n_out, n_targets) of the edges of CALLS and REFERENCES, counted on keys before any is written out as text.

    Edges of a function go to as many targets as its lines have keys; those to a null key count but have no target.
    """
    known = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("m"))
    counted = None
    for key in ("l_suppkey", "l_partkey"):
        pairs = t.lineitem.select("l_orderkey", F.col(key).alias("key")).distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("k"))
        counted = pairs if counted is None else counted.unionByName(pairs)
    counted = counted.groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    joined = counted.join(known, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(node_id("function", "l_orderkey").alias("from_id"), (F.col("n") * F.col("m")).alias("n_out"), F.col("k").alias("n_targets"))


def confidence(priority: Column) -> Column:
    return F.when(priority.startswith("1") | priority.startswith("2"), "high").when(priority.startswith("3"), "medium").otherwise("fallback")


def _depends(t: Tables, plain) -> DataFrame:
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").distinct().join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.filter("c_nationkey <> s_nationkey").select("c_nationkey", "s_nationkey").distinct()
    return plain(pairs, "DEPENDS_ON", node_id("package", "c_nationkey"), node_id("package", "s_nationkey"))


def ring(t: Tables) -> DataFrame:
    """A synthetic graph over parts: i -> (17 i + 11) mod N, kinds in turn by i mod 5."""
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.lit(k) for k in ("CALLS", "REFERENCES", "IMPORTS", "DEFINES", "MENTIONS")])
    i = F.col("p_partkey")
    return t.part.select("p_partkey").join(F.broadcast(n)).select(F.get(kinds, (i % 5).cast("int")).alias("kind"), i.alias("from_id"), ((i * 17 + 11) % F.col("n")).alias("to_id"))
