"""Evaluation of search and graph against expectations: cases from JSON packs, ranks, metrics, checks and roll-ups."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import glob_regex
from graphloom.operators import traversal

#: What a failed case counts as where it gives no hint.
FAILURE_OF_MODE = {"semantic": "embedding", "find-symbol": "query"}
CASE = "id string, name string, mode string, query string, limit int, capability string, layer string, gate string, hint string, wanted boolean, n int, file string, symbol string, kind string, max_rank int"


def load_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Expectations of all cases in the JSON files below a folder: a row per case and expectation (wanted or not), ``CASE``."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    one = "struct<id:string,name:string,mode:string,query:string,limit:int,gate:struct<status:string,capability:string,layer:string>,failureClassHint:string,expected:array<struct<file:string,symbol:string,kind:string,maxRank:int>>,notExpected:array<struct<file:string,symbol:string,kind:string,maxRank:int>>>"
    cases = files.select(F.explode(F.from_json("value", f"struct<cases:array<{one}>>")["cases"]).alias("c")).select("c.*")

    def listed(column: str, wanted: bool) -> Column:
        row = lambda e, i: F.struct(F.lit(wanted).alias("wanted"), (i + 1).cast("int").alias("n"), e["file"].alias("file"), e["symbol"].alias("symbol"), e["kind"].alias("kind"), e["maxRank"].alias("max_rank"))
        return F.transform(F.coalesce(column, F.array()), row)

    every = F.concat(listed("expected", True), listed("notExpected", False))
    return cases.filter("query is not null").select("id", "name", "mode", "query", "limit", "gate.capability", "gate.layer", F.col("gate.status").alias("gate"), F.col("failureClassHint").alias("hint"), F.explode_outer(every).alias("e")).select("id", "name", "mode", "query", "limit", "capability", "layer", "gate", "hint", "e.*")


def file_fits(pattern: Column, file: Column) -> Column:
    """Whether a result's file is that of an expectation, which may have stars."""
    plain = F.regexp_replace(pattern, r"([\\^$.+?()\[\]{}|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.replace(plain, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))
    return F.when(F.instr(pattern, "*") > 0, F.rlike(file, regex)).otherwise(file == pattern)


def ranked_expectations(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases with ``rank``: the place of the result that fits, for the k-th of equal expectations the k-th such result.

    results: (id of the case, rank from 1, file, symbol, kind).
    """
    same = Window.partitionBy("id", "wanted", "file", "symbol", "kind").orderBy("n")
    asked = cases.withColumn("_turn", F.row_number().over(same)).filter("n is not null")
    told = results.select(F.col("id").alias("_id"), F.col("rank").alias("_rank"), F.col("file").alias("_file"), F.col("symbol").alias("_symbol"), F.col("kind").alias("_kind"))
    fits = (F.col("id") == F.col("_id")) & file_fits(F.col("file"), F.col("_file")) & (F.col("symbol").isNull() | (F.col("symbol") == F.col("_symbol"))) & (F.col("kind").isNull() | (F.col("kind") == F.col("_kind")))
    met = asked.join(told, fits).groupBy("id", "wanted", "n", "_turn").agg(F.array_sort(F.collect_list("_rank")).alias("_ranks"))
    found = met.select("id", "wanted", "n", F.get("_ranks", F.col("_turn") - 1).alias("rank"))
    return cases.join(found, ["id", "wanted", "n"], "left")


def case_results(expectations: DataFrame) -> DataFrame:
    """A row per case: status, failure_class and metrics, from expectations with ranks.

    A case passes if all wanted results are there, in time for their max_rank, and no unwanted one is (or only after its own).
    """
    good = F.col("rank").isNotNull() & (F.col("max_rank").isNull() | (F.col("rank") <= F.col("max_rank")))
    clean = F.col("rank").isNull() | F.coalesce((F.col("max_rank") > 0) & (F.col("rank") > F.col("max_rank")), F.lit(False))
    wanted = F.coalesce("wanted", F.lit(True))
    rows = expectations.withColumn("ok", F.when(F.col("n").isNull(), True).when(wanted, good).otherwise(clean))
    k = F.coalesce("limit", F.lit(10))
    top = F.coalesce("wanted", F.lit(False)) & (F.col("rank") <= F.col("k"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    m = rows.withColumn("k", k).groupBy("id").agg(
        *map(first, ("name", "mode", "capability", "layer", "gate", "hint", "k")),
        F.min("ok").alias("passed"),
        F.count_if("wanted").alias("n_wanted"),
        F.min(F.when(top, F.col("rank"))).alias("best"),
        F.count_if(top).alias("hits"),
        F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.count_if(~F.col("wanted") & ~F.col("ok")).alias("false_positives"),
        F.max(F.coalesce((~F.col("wanted") & F.col("rank").isNotNull()) | (F.col("wanted") & F.col("rank").isNotNull() & ~F.col("ok")), F.lit(False))).alias("misplaced"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_wanted", "k")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    default = F.coalesce(F.create_map(*[F.lit(x) for pair in FAILURE_OF_MODE.items() for x in pair])[F.col("mode")], F.lit("graph"))
    failure = F.when(F.col("passed"), None).when(F.col("misplaced"), "ranking").otherwise(F.coalesce("hint", default))
    return m.select(
        "id", "name", "mode", "capability", "layer", "gate",
        F.when(F.col("passed"), "pass").otherwise("fail").alias("status"),
        failure.alias("failure_class"),
        F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n_wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("n_wanted")), 6).alias("recall"),
        F.round(F.when(F.col("n_wanted") == 0, 1.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
        "false_positives",
    )


def rollup(results: DataFrame) -> DataFrame:
    """(scope, key, total, passed, failed, blocking, mrr, recall, ndcg, false_positives) by gate, capability and layer, failure class, and over all."""
    parts = []
    for scope, column in (("all", F.lit("all")), ("gate", F.col("gate")), ("capability", F.col("capability")), ("layer", F.col("layer")), ("failure", F.col("failure_class"))):
        rows = results.withColumn("key", column).filter("key is not null")
        bad = F.col("status") == "fail"
        parts.append(
            rows.groupBy("key").agg(
                F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("gate") == "required")).alias("blocking"),
                *[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "recall", "ndcg")], F.sum("false_positives").alias("false_positives"),
            ).withColumn("scope", F.lit(scope))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("scope", "key", "total", "passed", "failed", "blocking", "mrr", "recall", "ndcg", "false_positives")


def select_nodes(nodes: DataFrame, file: str | None = None, symbol: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes by a file glob, a name (case doesn't matter) and a kind, as far as given."""
    keep = F.lit(True)
    if file:
        keep = keep & F.coalesce(F.col("file").rlike(glob_regex(file)), F.lit(False))
    if symbol:
        keep = keep & F.coalesce(F.lower("name") == symbol.lower(), F.lit(False))
    if kind:
        keep = keep & (F.col("kind") == kind)
    return nodes.filter(keep)


def graph_check(nodes: DataFrame, edges: DataFrame, check: dict) -> dict:
    """One graph check: ``type`` edge-exists, no-edge, path-exists or no-path, with selectors ``from`` and ``to`` or
    ``nodes`` in order, ``kinds``, ``direction``, ``depth`` and ``require_evidence``. Says whether it holds and why not.

    What isn't found can't be linked: selectors without nodes fail a check for something and pass one against it.
    """
    selectors = check["nodes"] if check["type"] == "path-exists" else [check["from"], check["to"]]
    groups = [select_nodes(nodes, **s).select("id") for s in selectors]
    wants = check["type"].endswith("exists")
    empty = next((i for i, g in enumerate(groups) if g.isEmpty()), None)
    if empty is not None:
        return {"passed": not wants, "issue": f"selector {empty + 1} has no nodes" if wants else None}
    direction, kinds = check.get("direction", "outgoing"), check.get("kinds")
    require = check.get("require_evidence") if wants else None
    steps = traversal.steps_of(edges, direction, kinds, require)
    if check["type"] in ("edge-exists", "no-edge"):
        found = not steps.join(groups[0].withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(groups[1].withColumnRenamed("id", "to_id"), "to_id", "left_semi").isEmpty()
    else:
        placed = groups[0].select(F.lit(0).alias("place"), "id")
        for place, g in enumerate(groups[1:], 1):
            placed = placed.unionByName(g.select(F.lit(place).alias("place"), "id"))
        closed = None if "DEPENDS_ON" in (kinds or ()) else nodes.filter("kind = 'Package'").select("id")
        found = not traversal.ordered_paths(steps, placed.withColumn("seq", F.lit(0)), check.get("depth", 4), closed=closed).isEmpty()
    return {"passed": found == wants, "issue": None if found == wants else ("not found" if wants else "forbidden, but found")}


def partial_match(fact: dict, wanted: dict) -> bool:
    """Whether a fact has all that is wanted: equal values, nested ones in turn, and patterns written /.../."""
    for key, value in wanted.items():
        have = fact.get(key)
        if isinstance(value, dict):
            if not isinstance(have, dict) or not partial_match(have, value):
                return False
        elif isinstance(value, str) and len(value) > 1 and value[0] == value[-1] == "/":
            if not isinstance(have, str) or not re.search(value[1:-1], have):
                return False
        elif have != value:
            return False
    return True


def fact_checks(facts: DataFrame, checks: list[dict]) -> DataFrame:
    """(n, found, passed) of checks on source facts: ``path``, ``where`` (columns with values), ``wanted`` (default true)."""
    spark = facts.sparkSession
    rows = [(i, json.dumps(c.get("where", {})), c.get("path"), bool(c.get("wanted", True))) for i, c in enumerate(checks)]
    asked = spark.createDataFrame(rows, "n int, `where` string, at string, wanted boolean")
    columns = [c for c in facts.columns if c != "path"]
    wanted = F.from_json("where", "map<string,string>")
    have = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    told = facts.select("path", have.alias("have"))
    fits = (F.col("at").isNull() | (F.col("at") == F.col("path"))) & F.forall(F.map_entries(F.col("need")), lambda e: F.element_at("have", e["key"]).eqNullSafe(e["value"]))
    met = asked.withColumn("need", wanted).join(told, fits, "left").groupBy("n", "wanted").agg(F.count("path").alias("found"))
    return met.select("n", "found", ((F.col("found") > 0) == F.col("wanted")).alias("passed"))


def run_cases(engine, cases: DataFrame) -> DataFrame:
    """Results (id, rank, file, symbol, kind) of the cases' questions, asked of an engine by their mode.

    Cases are a pack's, so their number doesn't grow with the graph; each question is a plan of its own.
    """
    asks = {"find-symbol": engine.find_symbol, "callers": engine.callers, "callees": engine.callees, "references": engine.references, "semantic": engine.semantic_search}
    orders = {"callers": ("rank",), "callees": ("rank",), "find-symbol": ("rank",)}
    shape = "id string, rank int, file string, symbol string, kind string"
    out = []
    for case in cases.select("id", "mode", "query", "limit").distinct().orderBy("id").collect():
        rows = asks[case["mode"]](case["query"], case["limit"] or 10).collect()
        if case["mode"] in orders:
            rows = sorted(rows, key=lambda r: tuple(r[c] for c in orders[case["mode"]]))
        out += [(case["id"], i, r["file"], r["name"], r["kind"]) for i, r in enumerate(rows, 1)]
    return engine.spark.createDataFrame(out, shape)


def run_suite(engine, folder: str) -> tuple[DataFrame, DataFrame]:
    """(case results, roll-up) of a pack's query cases."""
    cases = load_pack(engine.spark, folder)
    results = case_results(ranked_expectations(cases, run_cases(engine, cases)))
    return results, rollup(results)
