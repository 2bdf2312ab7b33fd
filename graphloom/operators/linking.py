"""Links of tests with what they test: by request path, by mocks, by snapshots, by name and place, and through others.

All steps are joins of facts; a test case stands for the calls inside it. Every link says how it came about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import http_path, route_path
from graphloom.operators.path_ranking import METHODS

METHOD_PATTERN = f"^(?i)({'|'.join(METHODS)})$"


def route_of(path: Column) -> Column:
    """The route a file serves by its place, null if by none."""
    place = F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)app/api/(.+)/route\.[cm]?[jt]sx?$", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"(?:^|/)pages/api/(.+)\.[cm]?[jt]sx?$", 1), F.lit("")))
    return F.when(place.isNotNull(), route_path(place))


def route_targets(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, path, method, route): handlers named like request methods, or the file itself where it has none."""
    served = files.filter("file_kind = 'source'").select("path", route_of(F.col("path")).alias("route")).filter("route is not null")
    handlers = symbols.filter(F.col("name").rlike(METHOD_PATTERN)).select(F.col("path").alias("_p"), "id", F.upper("name").alias("method"))
    joined = served.join(handlers, F.col("path") == F.col("_p"), "left")
    return joined.select(F.coalesce("id", F.concat(F.lit("file:"), "path")).alias("id"), "path", "method", "route")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def requests(facts: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, line, method, url): calls of a member named like a request method with a path, in test files."""
    calls = facts.filter("kind = 'call' AND detail = 'member' AND argument IS NOT NULL").filter(F.col("name").rlike(METHOD_PATTERN))
    return calls.join(tests.select("path"), "path", "left_semi").select("path", "line", F.upper("name").alias("method"), http_path(F.col("argument")).alias("url"))


def by_route(targets: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with the targets whose route and method fit, with or without /api in front. An equi-join on the number of
    segments and the method; handlers without a method take any."""
    bare = targets.select("id", F.col("path").alias("target_file"), "method", F.explode(F.array("route", F.when(F.col("route").startswith("/api/"), F.substr("route", F.lit(5))).otherwise(F.concat(F.lit("/api"), "route")))).alias("route"))
    shaped = bare.withColumn("seg", segments(F.col("route"))).withColumn("n", F.size("seg")).withColumn("m", F.explode(F.when(F.col("method").isNull(), F.array(*[F.lit(x) for x in METHODS])).otherwise(F.array("method"))))
    wanted = asked.withColumn("want", segments(F.col("url"))).withColumn("n", F.size("want")).withColumnRenamed("method", "m")
    fits = F.forall(F.zip_with("seg", "want", lambda r, w: r.startswith(":") | (r == w)), lambda x: x)
    return wanted.join(shaped, ["n", "m"]).filter(fits).select("path", "line", F.col("m").alias("method"), "url", "id", "target_file").distinct()


def cases(facts: DataFrame) -> DataFrame:
    """(path, case, how, line, end_line) of test cases and suites."""
    return facts.filter("kind = 'test'").select("path", F.col("name").alias("case"), F.col("detail").alias("how"), "line", "end_line")


def with_case(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows (path, line) with ``case``: of the cases around the line the best (a case before a suite, then the smallest);
    where there is none, a file's only case."""
    have = told.select(F.col("path").alias("_p"), "case", "how", F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    places = rows.select("path", "line").distinct()
    rank = F.struct((F.col("how") == "describe").alias("suite"), (F.col("_b") - F.col("_a")).alias("size"), F.col("case").alias("c"))
    inside = places.join(have, (F.col("path") == F.col("_p")) & (F.col("_a") <= F.col("line")) & (F.col("_b") >= F.col("line"))).groupBy("path", "line").agg(F.min(rank)["c"].alias("_in"))
    only = told.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("case").alias("_only")).filter("_n = 1").select("path", "_only")
    joined = rows.join(inside, ["path", "line"], "left").join(only, "path", "left")
    return joined.withColumn("case", F.coalesce("_in", "_only")).drop("_in", "_only")


def mocks(facts: DataFrame, resolved: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, line, target): files that a test mocks."""
    calls = facts.filter(F.col("specifier").isin("vi.mock", "jest.mock") & (F.col("kind") == "call") & F.col("argument").isNotNull())
    return calls.join(tests.select("path"), "path", "left_semi").select("path", "line", F.col("argument").alias("specifier")).join(resolved.filter("target is not null").select("path", "specifier", "target"), ["path", "specifier"]).select("path", "line", "target")


def snapshots(facts: DataFrame, bound: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, symbol): what test files with a snapshot assertion import. bound: (path, symbol, target)."""
    asserts = facts.filter("kind = 'call'").filter(F.col("name").rlike("^toMatch(Inline|File)?Snapshot$|^toThrowErrorMatching(Inline)?Snapshot$"))
    files = asserts.join(tests.select("path"), "path", "left_semi").select("path").distinct()
    return bound.join(files, "path", "left_semi").select("path", "symbol", "target").distinct()


def colocated(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, source): test files with the source file of their own name, beside them or above their folder of tests."""
    plain = F.regexp_replace("path", r"\.(test|spec)(\.[cm]?[jt]sx?)$", "$2")
    up = F.regexp_replace(plain, r"(^|/)(__tests__|tests?)/", "$1")
    extensions = F.array(*[F.lit(e) for e in ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")])
    stem = lambda c: F.regexp_replace(c, r"\.[cm]?[jt]sx?$", "")
    tried = F.array_distinct(F.concat(F.array(plain, up), F.transform(extensions, lambda e: F.concat(stem(plain), F.lit("."), e)), F.transform(extensions, lambda e: F.concat(stem(up), F.lit("."), e))))
    each = tests.select("path", F.posexplode(tried).alias("place", "source")).filter("source <> path")
    return each.join(sources.select(F.col("path").alias("source")), "source").groupBy("path").agg(F.min_by("source", "place").alias("source"))


def normalized(links: DataFrame, told: DataFrame) -> DataFrame:
    """Direct links (path, line, from_id, to_id, evidence, confidence, roles) with kind of link, test evidence and case."""
    kind = F.when(F.array_contains("roles", "Call"), "direct-call").when(F.array_contains("roles", "Import"), "direct-import").otherwise("direct-reference")
    sure = F.coalesce("confidence", F.when(F.col("link") == "direct-import", "medium").otherwise("high"))
    rows = with_case(links, told).withColumn("link", kind)
    return rows.withColumn("confidence", sure).withColumn("evidence", F.array_sort(F.array_union("evidence", F.array(F.lit("test-syntax")))))


def indirect(direct: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(from_id, to_id, via_id, hops): what tests reach from their direct targets within ``hops`` calls, references,
    imports or exports, one of them a call, without what they link directly."""
    steps = edges.filter(F.col("kind").isin("CALLS", "REFERENCES", "IMPORTS", "EXPORTS")).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), (F.col("kind") == "CALLS").alias("call"))
    now = direct.select("from_id", F.col("to_id").alias("via_id"), F.col("to_id").alias("at"), F.lit(False).alias("called")).distinct()
    out = None
    for hop in range(1, hops + 1):
        now = now.join(steps, F.col("at") == F.col("a")).select("from_id", "via_id", F.col("b").alias("at"), (F.col("called") | F.col("call")).alias("called")).groupBy("from_id", "via_id", "at").agg(F.max("called").alias("called"))
        hit = now.filter("called").select("from_id", F.col("at").alias("to_id"), "via_id", F.lit(hop).alias("hops"))
        out = hit if out is None else out.unionByName(hit)
    fresh = out.filter("from_id <> to_id").join(direct.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    w = Window.partitionBy("from_id", "to_id").orderBy("hops", "via_id")
    return fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
