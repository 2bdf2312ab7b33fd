"""Scalar text functions as Column expressions: tokenizing, hashing, ids, paths and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_START, FNV_STEP, U32 = 2166136261, 16777619, 4294967296


def tokens(text: Column) -> Column:
    """Words of code: camelCase is split, case dropped, then runs of a-z, 0-9 and _."""
    spread = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spread), "[^a-z0-9_]+"), lambda x: x != "")


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_STEP, F.lit(U32))
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(FNV_START).cast("long"), step)


def needles(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_$]+"), lambda x: x != ""))


def query_words(query: Column) -> Column:
    words = F.transform(F.regexp_extract_all(query, F.lit(r"[a-zA-Z_$][a-zA-Z0-9_$]*"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: F.length(w) > 2)


def camel(words: Column) -> Column:
    """camelCase of an array of words."""
    rest = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))


def camel_grams(words: Column, n: int) -> Column:
    """camelCase of each run of n words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: camel(F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def stable_id(kind: Column, workspace: Column, repo: Column, commit: Column, path: Column, suffix: Column) -> Column:
    return F.concat(kind, F.lit(":"), workspace, F.lit(":"), repo, F.lit("@"), commit, F.lit(":"), normal_path(path), F.lit("#"), suffix)


def edge_id(kind: Column, from_id: Column, to_id: Column) -> Column:
    return F.concat(F.lit("edge:"), kind, F.lit(":"), from_id, F.lit("->"), to_id)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def truncate_utf8(text: Column, most: int, suffix: str = "\n[truncated]") -> Column:
    """At most ``most`` bytes, cut between characters, the suffix inside the budget."""
    raw = text.cast("binary")
    room = most - len(suffix.encode())
    byte = lambda k: F.conv(F.hex(F.substring(raw, room + k, 1)), 16, 10).cast("int")
    carries_on = lambda k: F.coalesce(byte(k).bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))
    # up to three continuation bytes may follow the cut; step back to the start of that character
    back = F.when(~carries_on(1), 0).when(~carries_on(0), 1).when(~carries_on(-1), 2).otherwise(3)
    cut = F.substring(raw, F.lit(1), F.lit(room) - back).cast("string")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(suffix)))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression; a plain folder stands for all below it."""
    if not re.search(r"[*?]", pattern) and not pattern.endswith("/**") and "." not in pattern.rsplit("/", 1)[-1]:
        pattern = pattern.rstrip("/") + "/**"
    out, i = "", 0
    while i < len(pattern):
        for sign, means in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(sign, i):
                out, i = out + means, i + len(sign)
                break
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[cm]?[jt]sx?$")


def package_of(specifier: Column) -> Column:
    """The package an import names, null for relative ones."""
    return F.when(specifier.rlike(r"^[./]"), None).otherwise(F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1))


def route_path(path: Column) -> Column:
    """A route from a path: groups in brackets go, parameters become :name."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda p: F.regexp_replace(p, r"^\[(?:\.\.\.)?([^\]]+)\]$", ":$1"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def http_path(url: Column) -> Column:
    """A request's path: no origin, query or closing slash, one slash in front."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(bare, r"^/+|/+$", ""))


#: Bits of an occurrence's role mask.
ROLES = {1: "Definition", 2: "Import", 4: "WriteAccess", 8: "ReadAccess", 16: "Generated", 32: "Test", 64: "ForwardDefinition"}


def role_names(mask: Column) -> Column:
    """Names of the bits set, ReadAccess if none is."""
    names = F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) > 0, F.lit(n)) for b, n in ROLES.items()]))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("ReadAccess")))


def module_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[cm]?[jt]sx?$", "")
