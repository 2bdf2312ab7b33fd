"""Source trees as tables: files with why each is in or out, their package, fingerprint and text; JSON with comments."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import glob_regex, is_test_path

#: Folders that are never source, extensions that are, and what tells of each package manager.
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", "out", "target", "vendor", "__pycache__")
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
LOCKFILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))


@dataclass(frozen=True)
class Policy:
    """What a scan leaves out; hidden folders are out unless allowed by name."""

    ignored: tuple[str, ...] = IGNORED
    allowed_hidden: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_generated: bool = False
    extensions: tuple[str, ...] = field(default=EXTENSIONS)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root: path (relative, with /), bytes, modified, content. Any file system Spark reads will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    at = F.locate(f"{base}/", F.col("path"))
    path = F.substr("path", at + len(base) + 1)
    return files.filter(at > 0).select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def reason(path: Column, policy: Policy) -> Column:
    """Why a file is out, the first that applies, or ``included``."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    ignored = F.exists(folders, lambda d: d.isin(*policy.ignored))
    hidden = F.exists(folders, lambda d: d.startswith(".") & (~d.isin(*policy.allowed_hidden) if policy.allowed_hidden else F.lit(True)))
    generated = path.rlike(r"(^|/)(generated|__generated__)/|\.(generated|gen|min)\.[cm]?[jt]sx?$|\.d\.ts$")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    excluded = F.lit(False)
    for pattern in policy.exclude:
        excluded = excluded | path.rlike(glob_regex(pattern))
    out = F.when(ignored | hidden, "build-artifact")
    if not policy.include_generated:
        out = out.when(generated, "generated")
    return out.when(~extension.isin(*policy.extensions), "unsupported-extension").when(excluded & ~is_test_path(path), "config-excluded").otherwise("included")


def strip_comments(text: Column) -> Column:
    """JSON from JSON with comments and trailing commas; strings are left alone."""
    kept = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(kept, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def packages(files: DataFrame) -> DataFrame:
    """(folder, package_name, dependencies): each package.json, later kinds of dependencies winning."""
    spec = "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    found = files.filter(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").rlike("(^|/)node_modules/"))
    parsed = found.select(F.regexp_replace("path", r"/?package\.json$", "").alias("folder"), F.from_json(strip_comments(F.col("content").cast("string")), spec).alias("p"))
    empty = F.create_map().cast("map<string,string>")
    kinds = [F.coalesce(f"p.{k}", empty) for k in ("dependencies", "devDependencies", "peerDependencies")]
    keys = F.array_sort(F.array_distinct(F.concat(*[F.map_keys(k) for k in kinds])))
    pick = lambda k: F.coalesce(F.element_at(kinds[2], k), F.element_at(kinds[1], k), F.element_at(kinds[0], k))
    return parsed.select("folder", F.coalesce("p.name", F.when(F.col("folder") == "", "root").otherwise(F.substring_index("folder", "/", -1))).alias("package_name"), F.map_from_arrays(keys, F.transform(keys, pick)).alias("dependencies"))


def discover(spark: SparkSession, root: str, policy: Policy = Policy()) -> DataFrame:
    """Files with reason, deepest enclosing package, kind, content hash and text of included ones."""
    return discovered(scan(spark, root), policy)


def discovered(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The same from rows (path, bytes, modified, content)."""
    named = packages(files).select("folder", "package_name")
    rows = files.withColumn("reason", reason(F.col("path"), policy))
    # the deepest package above a file, by an equi-join on all of its folders
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    homes = files.select("path", F.explode(above).alias("folder")).join(named, "folder").groupBy("path").agg(F.max_by("package_name", F.length("folder")).alias("package_name"))
    rows = rows.join(homes, "path", "left")
    text = F.when(F.col("reason") == "included", F.col("content").cast("string"))
    return rows.select("path", "package_name", "reason", F.when(is_test_path(F.col("path")), "test").otherwise("source").alias("file_kind"), "bytes", "modified", F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def package_manager(files: DataFrame) -> str:
    """By the first lockfile there is at the root."""
    names = {r["path"] for r in files.filter(F.col("path").isin(*[n for n, _ in LOCKFILES])).select("path").collect()}
    return next((manager for name, manager in LOCKFILES if name in names), "unknown")


def config_hash(options: dict, config_texts: dict[str, str]) -> str:
    """One hash of all that makes earlier facts invalid."""
    import hashlib

    return hashlib.sha256(json.dumps([options, sorted(config_texts.items())], sort_keys=True).encode()).hexdigest()


def parse_jsonc(text: str) -> object:
    """The same rules as ``strip_comments``, for one document on the driver."""
    string = r'("(?:[^"\\]|\\.)*")'
    text = re.sub(string + r"|//[^\n]*|/\*[\s\S]*?\*/", lambda m: m[1] or "", text)
    return json.loads(re.sub(string + r"|,(?=\s*[}\]])", lambda m: m[1] or "", text))
