"""Compiler indexes as tables: a small reader of the public index format's protocol buffers, one file a row.

Files are read as binary rows, decoded in Arrow batches, and become definitions and occurrences; merging shards,
references and all joins with other facts are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_path, role_names

MOST_BYTES = 128_000_000
#: Fixed values of the format: kinds of symbols by number, those that the graph tells apart.
KINDS = {7: "Class", 9: "Constructor", 11: "Enum", 12: "EnumMember", 17: "Function", 21: "Interface", 26: "Method", 29: "Module", 30: "Namespace", 41: "Property", 54: "Type", 55: "TypeAlias", 58: "TypeParameter", 61: "Variable"}
_DOC = (r"\bfunction\s+", r"\b(?:const|let|var)\s+", r"\bclass\s+", r"\binterface\s+", r"\btype\s+", r"\(method\)\s+", r"\(property\)\s+")
_SYMBOL = (r"/([A-Za-z_$][\w$]*)(?:\(\)\.|#|$)", r"`([^`]+)`\.", r"\.([A-Za-z_$][\w$]*)(?:\(\)|#)?$")

Fields = dict[int, list]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields_of(data: bytes) -> Fields:
    """Numbers and byte strings of a message by field."""
    out: Fields = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("the message ends early")
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        out.setdefault(number, []).append(value)
    return out


def _numbers(values: list) -> list[int]:
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = _varint(v, at)
            out.append(n)
    return out


def _text(values: list | None) -> str:
    return values[-1].decode("utf-8", "replace") if values else ""


def converted_range(numbers: list[int]) -> tuple[int, int, int, int] | None:
    """(start line, end line, start column, end column), lines from 1; three numbers are a range within a line."""
    if len(numbers) == 3:
        return numbers[0] + 1, numbers[0] + 1, numbers[1], numbers[2]
    return (numbers[0] + 1, numbers[2] + 1, numbers[1], numbers[3]) if len(numbers) == 4 else None


def symbol_name(documentation: list[str], symbol: str) -> str | None:
    """A symbol's plain name, from its documentation's signature or else its last part."""
    doc = "\n".join(documentation)
    for lead in _DOC:
        if m := re.search(lead + r"([A-Za-z_$][\w$]*)", doc):
            return m[1]
    return next((m[1] for p in _SYMBOL if (m := re.search(p, symbol))), None)


def is_parameter(symbol: str) -> bool:
    return re.search(r"\([^)]*[A-Za-z_$][\w$]*\)$", symbol) is not None


def whole_symbol(path: str, symbol: str) -> str:
    """Local symbols are told apart by file."""
    return f"local {path} {symbol[6:]}" if re.match(r"local \d+", symbol) else symbol


def rows_of(data: bytes) -> list[dict]:
    """Definitions and occurrences of one index, as rows of ``FACTS``."""
    if len(data) > MOST_BYTES:
        raise ValueError(f"the index exceeds {MOST_BYTES} bytes")
    index = fields_of(data)
    told: dict[str, tuple[list[str], int]] = {}

    def describe(raw: bytes) -> tuple[str, list[str], int]:
        f = fields_of(raw)
        return _text(f.get(1)), [d.decode("utf-8", "replace") for d in f.get(3, [])], (_numbers(f.get(5, [])) or [0])[-1]

    for raw in index.get(3, []):
        symbol, docs, kind = describe(raw)
        told[whole_symbol("", symbol)] = docs, kind
    documents = []
    for raw in index.get(2, []):
        f = fields_of(raw)
        path = _text(f.get(1))
        seen = []
        for o in map(fields_of, f.get(2, [])):
            seen.append((_text(o.get(2)), (_numbers(o.get(3, [])) or [0])[-1], converted_range(_numbers(o.get(1, []))), converted_range(_numbers(o.get(7, [])))))
        documents.append((path, seen, [describe(s) for s in f.get(3, [])]))
    out, names = [], {}

    def row(what: str, symbol: str, name: str, kind: str, path: str, range_, around, mask: int, docs: list[str] | None) -> dict:
        r = range_ or (None,) * 4
        e = around or (None,) * 4
        return {"what": what, "symbol": symbol, "name": name, "symbol_kind": kind, "path": path, "start_line": r[0], "end_line": r[1], "start_col": r[2], "end_col": r[3], "enclosing_start": e[0], "enclosing_end": e[1], "role_mask": mask, "documentation": docs}

    for path, seen, symbols in documents:
        at = {s: (r, e) for s, mask, r, e in reversed(seen) if mask & 1}
        for symbol, docs, kind in symbols:
            name = symbol_name(docs, symbol)
            if not name or is_parameter(symbol):
                continue
            whole = whole_symbol(path, symbol)
            told[whole] = docs, kind
            names[whole] = name, KINDS.get(kind, "Unknown")
            r, e = at.get(symbol, (None, None))
            out.append(row("definition", whole, name, KINDS.get(kind, "Unknown"), path, r, e, 1, docs))
    for path, seen, _ in documents:
        for symbol, mask, r, e in seen:
            if not symbol or is_parameter(symbol):
                continue
            whole = whole_symbol(path, symbol)
            docs, kind = told.get(whole, ([], 0))
            name, kind_name = names.get(whole) or (symbol_name(docs, symbol), KINDS.get(kind, "Unknown"))
            if name:
                out.append(row("occurrence", whole, name, kind_name, path, r, e, mask, None))
    return out


FACTS = "what string, symbol string, name string, symbol_kind string, path string, start_line int, end_line int, start_col int, end_col int, enclosing_start int, enclosing_end int, role_mask int, documentation array<string>"
_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32()}.get(c.split()[1], pa.list_(pa.string()))) for c in FACTS.split(", ")])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Definitions and occurrences (``FACTS``, with the file each came from) of all index files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scip").load(path)
    return decode(files.select(F.col("path").alias("shard"), "content"))


def decode(files: DataFrame) -> DataFrame:
    """The same from rows (shard, content). Null content has no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                rows = rows_of(content) if content is not None else []
                made = pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.string()), *made.columns], names=["shard", *_SCHEMA.names])

    return files.mapInArrow(run, f"shard string, {FACTS}")


def merged(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(definitions, occurrences, references) of all shards: the first shard's definition of a symbol stands, an
    occurrence counts once, references take names and kinds from definitions."""
    one = Window.partitionBy("symbol").orderBy("shard", "path", "start_line", "start_col")
    definitions = facts.filter("what = 'definition'").withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "what", "role_mask")
    same = Window.partitionBy("symbol", "path", "start_line", "start_col", "end_line", "end_col", "role_mask").orderBy("shard")
    seen = facts.filter("what = 'occurrence'").withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n", "what", "documentation")
    has = lambda bit: F.col("role_mask").bitwiseAND(F.lit(bit)) == bit
    seen = seen.withColumns({"roles": role_names(F.col("role_mask")), "is_definition": has(1), "is_import": has(2), "is_write": has(4), "is_test": has(32) | is_test_path(F.col("path"))})
    known = definitions.select("symbol", F.col("name").alias("_name"), F.col("symbol_kind").alias("_kind"))
    references = seen.filter(~F.col("is_definition")).join(known, "symbol", "left")
    references = references.withColumn("name", F.coalesce("_name", "name")).withColumn("symbol_kind", F.coalesce("_kind", "symbol_kind")).drop("_name", "_kind", "is_definition", "role_mask")
    return definitions, seen, references


# ---- fusion with facts from source ----------------------------------------------------------------------------------


def node_kind(kind: Column) -> Column:
    return F.when(kind.isin("Class", "Interface", "TypeAlias"), kind).when(kind.isin("Function", "Method", "Constructor"), "Function").otherwise("Symbol")


def span(a: str, b: str, c: str, d: str) -> Column:
    """The size of a range: lines first, then columns; a missing one is the largest."""
    return F.coalesce((F.col(b) - F.col(a)) * 1000 + (F.coalesce(F.col(d), F.lit(0)) - F.coalesce(F.col(c), F.lit(0))), F.lit(2**53).cast("long"))


def matched(definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """definitions with ``id`` and ``kind``: the smallest declared symbol of their file, name and lines, or a new one.

    symbols: id, path, name, kind, line, end_line, and qualified_name if there.
    """
    long = F.col("qualified_name") if "qualified_name" in symbols.columns else F.lit(None).cast("string")
    have = symbols.select(F.col("path").alias("_path"), F.col("name").alias("_sn"), long.alias("_q"), F.col("id").alias("_id"), F.col("kind").alias("_k"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    named = (F.col("_sn") == F.col("name")) | (F.col("_q") == F.col("name")) | F.coalesce(F.col("_q").endswith(F.concat(F.lit("."), "name")), F.lit(False))
    overlaps = F.col("start_line").isNull() | ((F.col("_a") <= F.col("end_line")) & (F.col("start_line") <= F.col("_b")))
    pairs = definitions.select("symbol", "path", "name", "start_line", "end_line").join(have, F.col("path") == F.col("_path")).filter(named & overlaps)
    best = pairs.groupBy("symbol").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("s"), F.col("_id").alias("id"), F.col("_k").alias("k"))).alias("m"))
    own = F.concat(F.lit("symbol:"), "path", F.lit("#compiler-"), "name", F.lit("-"), F.substring(F.sha2("symbol", 256), 1, 10))
    kind = F.when(F.col("m.k").isNull() | (F.col("m.k") == "Symbol"), node_kind(F.col("symbol_kind"))).otherwise(F.col("m.k"))
    return definitions.join(best, "symbol", "left").select(*definitions.columns, F.coalesce("m.id", own).alias("id"), kind.alias("kind"), F.col("m.id").isNull().alias("new"))


def is_call(references: DataFrame, calls: DataFrame) -> DataFrame:
    """references with ``is_call``: neither import nor write, and a call of that name is on their line at or before them.

    calls: path, name, line, col of facts of kind call.
    """
    told = calls.select(F.col("path").alias("_p"), F.col("name").alias("_c"), F.col("line").alias("_l"), F.col("col").alias("_at")).distinct()
    on = (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_c")) & (F.col("start_line") == F.col("_l")) & (F.col("_at") <= F.col("start_col"))
    hit = references.filter("NOT is_import AND NOT is_write").join(told, on, "left_semi").select("symbol", "path", "start_line", "start_col").distinct().withColumn("_hit", F.lit(True))
    return references.join(hit, ["symbol", "path", "start_line", "start_col"], "left").withColumn("is_call", F.coalesce("_hit", F.lit(False))).drop("_hit")


def around(rows: DataFrame, spans: DataFrame, out: str) -> DataFrame:
    """rows (path, start_line, end_line) with ``out``, the id of the smallest span (path, id, line, end_line) that contains them, or null."""
    have = spans.select(F.col("path").alias("_p"), F.col("id").alias("_id"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    places = rows.select("path", "start_line", "end_line").distinct()
    inside = places.join(have, F.col("path") == F.col("_p")).filter("_a <= start_line AND _b >= end_line")
    best = inside.groupBy("path", "start_line", "end_line").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("s"), F.col("_id").alias("id"))).alias("m"))
    return rows.join(best, ["path", "start_line", "end_line"], "left").withColumn(out, F.col("m.id")).drop("m")


def fused_edges(definitions: DataFrame, references: DataFrame, symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges (kind, from_id, to_id, origin, confidence, evidence, owner_file) of an index over declared symbols.

    definitions come from ``matched``. A reference is one of its file and of the symbol and chunk around it; calls,
    tests, imports and heritage are told by the facts of its place; exports lead to what their name refers to.
    """
    parts: list[DataFrame] = []

    def add(df: DataFrame, kind: str, a: Column, b: Column, more: tuple[str, ...] = ()) -> None:
        evidence = F.array(*[F.lit(e) for e in sorted(("compiler", *more))])
        made = df.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit("compiler").alias("origin"), F.lit("high").alias("confidence"), evidence.alias("evidence"), F.col("path").alias("owner_file"))
        parts.append(made.filter("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id"))

    file = F.concat(F.lit("file:"), "path")
    add(definitions, "DEFINES", file, F.col("id"))
    targets = definitions.select("symbol", F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    used = around(is_call(references, facts.filter("kind = 'call'")).join(targets, "symbol"), symbols, "source")
    add(used, "REFERENCES", file, F.col("target"))
    add(used.filter("is_import"), "IMPORTS", file, F.col("target"))
    inside = used.filter("source <> target")
    add(inside, "REFERENCES", F.col("source"), F.col("target"))
    add(inside.filter("is_call"), "CALLS", F.col("source"), F.col("target"))
    add(inside.filter("is_test"), "TESTS", F.col("source"), F.col("target"))
    chunk = F.concat(F.lit("chunk:"), "source")
    add(used.filter("source is not null").withColumn("chunk", chunk), "MENTIONS", F.col("chunk"), F.col("target"))
    heritage = facts.filter("kind = 'heritage'").select(F.col("path").alias("_p"), F.col("name").alias("_owner"), F.col("detail").alias("how"), F.col("specifier").alias("_base")).distinct()
    owners = symbols.select(F.col("id").alias("source"), F.col("name").alias("_owner"), F.col("path").alias("_p"))
    typed = inside.filter(F.col("target_kind").isin("Class", "Interface", "TypeAlias")).join(owners, "source").join(heritage, ["_p", "_owner"]).filter(F.col("_base") == F.col("name"))
    for how in ("extends", "implements"):
        add(typed.filter(F.col("how") == how), how.upper(), F.col("source"), F.col("target"), ("type-relationship",))
    exports = facts.filter("kind = 'export'").select("path", F.col("line").alias("_line"), F.col("name").alias("_shown"), F.regexp_replace(F.coalesce("detail", "name"), "^type:", "").alias("_local"))
    by_place = exports.join(references.join(targets, "symbol").select(F.col("path").alias("_p"), F.col("start_line").alias("_l"), "target", F.col("name").alias("_rn")), (F.col("path") == F.col("_p")) & (F.col("_line") == F.col("_l")) & F.col("_rn").isin(F.col("_local"), F.col("_shown")))
    add(by_place, "EXPORTS", file, F.col("target"))
    by_name = exports.join(definitions.select(F.col("path").alias("_p"), F.col("name").alias("_dn"), F.col("id").alias("target")), (F.col("path") == F.col("_p")) & F.col("_dn").isin(F.col("_local"), F.col("_shown")))
    add(by_name, "EXPORTS", file, F.col("target"), ("export-syntax",))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    each = out.withColumn("_e", F.explode("evidence"))
    return each.groupBy("kind", "from_id", "to_id").agg(F.first("origin").alias("origin"), F.first("confidence").alias("confidence"), F.array_sort(F.collect_set("_e")).alias("evidence"), F.min("owner_file").alias("owner_file"))


# ---- runs of the indexer --------------------------------------------------------------------------------------------


def failure_kind(stderr: Column, exit_code: Column, timed_out: Column, signal: Column) -> Column:
    """Why a run failed."""
    said = F.lower(F.coalesce(stderr, F.lit("")))
    return (
        F.when(F.coalesce(timed_out, F.lit(False)) | said.contains("timed out"), "timeout")
        .when(said.contains("output file exceeded"), "oversized-output")
        .when(said.rlike("heap out of memory|allocation failed|reached heap limit|javascript heap"), "oom")
        .when(F.coalesce(signal.isin("SIGKILL", "SIGTERM"), F.lit(False)) | F.coalesce(exit_code.isin(137, 143), F.lit(False)), "killed")
        .otherwise("failed")
    )


def quality(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """runs (shard, ok, output_bytes, stderr, exit_code, timed_out, signal) with counts of their facts and warnings: empty or tiny output
    of a run that succeeded, the kind of failure of one that didn't."""
    counts = facts.groupBy("shard").agg(F.count_if(F.col("what") == "definition").alias("definitions"), F.count_if(F.col("what") == "occurrence").alias("occurrences"), F.count_if((F.col("what") == "occurrence") & (F.col("role_mask").bitwiseAND(F.lit(1)) == 0)).alias("references"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = runs.join(counts, "shard", "left").select(*runs.columns, *map(zero, ("definitions", "references", "occurrences")))
    tiny = F.col("ok") & ((F.col("output_bytes") < 128) | (F.col("definitions") + F.col("references") + F.col("occurrences") == 0))
    failed = F.concat(F.lit("index-"), failure_kind(F.col("stderr"), F.col("exit_code"), F.col("timed_out"), F.col("signal")))
    return rows.withColumn("warnings", F.array_compact(F.array(F.when(tiny, "index-empty-or-tiny"), F.when(~F.col("ok"), failed))))


def history_matches(files: DataFrame, history: DataFrame) -> DataFrame:
    """files (repo, path) with ``failed_before``: memory ran out for the file itself or a folder above it.

    history: repo, path_prefix, file_paths, failure_kind. Folders above a file are exploded, so this is an equi-join.
    """
    bad = history.filter("failure_kind = 'oom'")
    by_file = bad.filter(F.size(F.coalesce("file_paths", F.array())) > 0).select("repo", F.explode("file_paths").alias("at"), F.lit(True).alias("exact"))
    by_folder = bad.filter(F.size(F.coalesce("file_paths", F.array())) <= 0).select("repo", F.regexp_replace("path_prefix", "/$", "").alias("at"), F.lit(False).alias("exact"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    keyed = files.select("repo", "path", F.explode(above).alias("at"))
    hit = keyed.join(by_file.unionByName(by_folder), ["repo", "at"]).filter("NOT exact OR at = path").select("repo", "path").distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, ["repo", "path"], "left").withColumn("failed_before", F.coalesce("_hit", F.lit(False))).drop("_hit")


def file_cost(failed_before: Column, penalty: int = 1) -> Column:
    """What indexing a file costs: bytes, n_declarations, n_imports, n_types, generated; more where memory ran out before."""
    base = 1 + F.coalesce(F.ceil(F.col("bytes") / 1024), F.lit(1)) + 2 * F.col("n_declarations") + 2 * F.col("n_imports") + F.ceil(F.col("n_types") / 2) + F.when(F.col("generated"), 30).otherwise(0)
    return (base * F.when(failed_before, max(4, penalty * 10)).otherwise(1)).cast("long")


def split_retry(files: list[tuple[str, int]]) -> list[list[str]]:
    """Two halves of a shard that ran out of memory, costliest files first into the cheaper half."""
    halves: list[list[str]] = [[], []]
    costs = [0, 0]
    for path, cost in sorted(files, key=lambda f: (-f[1], f[0])):
        k = 0 if costs[0] <= costs[1] else 1
        halves[k].append(path)
        costs[k] += cost
    return [h for h in halves if h]


def run_adaptively(shard: dict, run, policy: dict, depth: int = 0, heap: int | None = None) -> list[dict]:
    """Outcomes of a shard (id, files as (path, cost)): run, and when memory runs out run its halves, then with a larger heap.

    run(shard, heap_mb) returns ok, stderr, exit_code, timed_out, signal. policy: heap_mb, most_splits, larger_heap_mb,
    tiny_files. It decides on one shard's own result, so shards can be run by any scheduler.
    """
    heap = heap or policy["heap_mb"]
    result = run(shard, heap)
    if result["ok"]:
        return [{"shard": shard["id"], "status": "succeeded", "heap_mb": heap, "files": [p for p, _ in shard["files"]]}]
    said = (result.get("stderr") or "").lower()
    oom = not result.get("timed_out") and "timed out" not in said and "output file exceeded" not in said and re.search("heap out of memory|allocation failed|reached heap limit|javascript heap", said)
    files = shard["files"]
    if oom and len(files) > 1 and depth < policy["most_splits"]:
        cost = dict(files)
        halves = split_retry(files)
        return [o for k, half in enumerate(halves, 1) for o in run_adaptively({"id": f"{shard['id']}-retry-{depth + 1}-{k}", "files": [(p, cost[p]) for p in half]}, run, policy, depth + 1)]
    if oom and heap < policy["larger_heap_mb"] and 0 < len(files) <= policy["tiny_files"]:
        return run_adaptively(shard, run, policy, depth + 1, policy["larger_heap_mb"])
    return [{"shard": shard["id"], "status": "failed", "heap_mb": heap, "files": [p for p, _ in files]}]
