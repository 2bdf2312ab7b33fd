"""Facts from source text: declarations, heritage, imports, exports, calls, members and test cases of JavaScript and
TypeScript files, by a small scanner of its own (no parser is at hand). One Arrow pass gives all facts of a file.

The scanner blanks comments and the inside of strings, keeping every line and column, and then reads statements by
pattern. What needs a full grammar (types of expressions, scopes of shadowed names) is out of its reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_$][\w$]*"
_BLANKED = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`")
_DECLARED = re.compile(rf"(?P<lead>\b(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?)\b(?P<kind>function\*?|class|interface|type|enum|namespace)\s+(?P<name>{_NAME})|(?P<lead2>\b(?:export\s+)?)(?:const|let|var)\s+(?P<name2>{_NAME})\s*(?::[^=;\n]+)?=\s*(?P<arrow>(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|{_NAME}\s*=>))?")
_IMPORT = re.compile(r"\bimport\s+(?P<type>type\s+)?(?P<what>[^'\"`;()]*?)\s*\bfrom\s*(?P<q>['\"])(?P<spec>[^'\"]*)(?P=q)|\bimport\s*(?P<q2>['\"])(?P<bare>[^'\"]*)(?P=q2)")
_DYNAMIC = re.compile(r"\bimport\s*\(\s*(?P<q>['\"`])(?P<spec>[^'\"`]*)(?P=q)")
_REQUIRE = re.compile(rf"(?:\b(?:const|let|var)\s+(?P<bound>{_NAME}|\{{[^}}]*\}})\s*=\s*)?\brequire\s*\(\s*(?P<q>['\"])(?P<spec>[^'\"]*)(?P=q)\s*\)")
_EXPORT = re.compile(r"\bexport\s+(?P<type>type\s+)?(?P<what>\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*(?:from\s*(?P<q>['\"])(?P<spec>[^'\"]*)(?P=q))?")
_DEFAULT = re.compile(rf"\bexport\s+default\s+(?!function\b|class\b|async\b|abstract\b|interface\b)(?P<name>{_NAME})?")
_COMMON = re.compile(rf"\b(?:module\.)?exports(?:\.(?P<name>{_NAME}))?\s*=(?!=)")
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<path>{_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:<[^<>()]*>)?\s*(?P<open>\(|`)")
_TEST = re.compile(r"\b(?P<kind>describe|it|test)(?:\.\w+)*\s*\(\s*(?P<q>['\"`])(?P<title>(?:[^\\'\"`]|\\.)*)(?P=q)")
_MEMBER = re.compile(rf"\b(?P<path>{_NAME}(?:\??\.{_NAME})+)(?!\s*[\w$(.`?<])")
#: Words before a bracket that are no calls.
_NO_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "import", "super", "constructor", "of", "in", "new", "delete", "void", "case", "do", "else", "async"}

_METHOD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*(?P<name>{_NAME})\s*(?:<[^<>]*>)?\s*\((?P<args>[^)]*)\)\s*(?::[^{{;=]+)?\{{", re.M)
_INJECTED = re.compile(rf"\b(?:private|public|protected|readonly)\s+(?:readonly\s+)?(?P<name>{_NAME})\??\s*:\s*(?P<type>{_NAME})")
_MEMBER_OF_ENUM = re.compile(rf"(?:^|[{{,])\s*(?P<name>{_NAME})\s*(?=[=,}}])")
_TYPE = re.compile(rf"(?::|\bas|\bsatisfies|\bkeyof|[<|&,=])\s*(?P<name>[A-Z][\w$]*)")
_AMBIENT = re.compile(r"\bdeclare\s+module\s+(?P<q>['\"])(?P<spec>[^'\"]+)(?P=q)")
_UNION = re.compile(rf"\btype\s+(?P<name>{_NAME})(?:<[^=]*>)?\s*=\s*(?P<members>\|?\s*{_NAME}(?:\s*\|\s*{_NAME})+)")
_ARGUMENT = re.compile(r"\s*(?:<[^>]+>\s*)?(?P<q>['\"`])(?P<first>[^'\"`\n]+)(?P=q)|[^;]{0,200}?\bpath\s*:\s*(?P<q2>['\"`])(?P<path>[^'\"`\n]+)(?P=q2)")

_HERITAGE = re.compile(rf"\b(?:class|interface)\s+(?P<name>{_NAME})(?:<[^>{{]*>)?\s+(?P<clauses>(?:extends|implements)\b[^{{]+)")

FACT = "kind string, name string, detail string, specifier string, exported boolean, line int, col int, end_line int, argument string"
FACT_NAMES = [c.split()[0] for c in FACT.split(", ")]


def blanked(text: str) -> tuple[str, str]:
    """The text without comments, and the same with the insides of strings blank too; both keep lines and columns."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    bare = _BLANKED.sub(lambda m: blank(m[0]) if m[0].startswith("/") else m[0], text)
    return bare, _BLANKED.sub(lambda m: blank(m[0]) if m[0].startswith("/") else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


def facts_of(text: str) -> list[tuple]:
    """All facts of one file, ordered by place."""
    bare, code = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[tuple] = []

    def place(at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(starts, at)
        return line, at - starts[line - 1]

    def add(kind: str, name: str | None, at: int, detail: str | None = None, specifier: str | None = None, exported: bool = False, end: int | None = None, argument: str | None = None) -> None:
        line, col = place(at)
        out.append((kind, name, detail, specifier, exported, line, col, place(end)[0] if end is not None else line, argument))

    methods = set()
    for m in _DECLARED.finditer(code):
        name = m["name"] or m["name2"]
        kind = (m["kind"] or ("function" if m["arrow"] else "variable")).rstrip("*")
        lead = m["lead"] or m["lead2"] or ""
        end = _block_end(code, m.end())
        add("declaration", name, m.start("name") if m["name"] else m.start("name2"), kind, None, "export" in lead, end)
        opened = code.find("{", m.end(), end)
        if opened >= 0 and kind == "class":
            for inner in _METHOD.finditer(code, opened + 1, end):
                if inner["name"] not in _NO_METHODS and _depth(code, opened + 1, inner.start("name")) == 0:
                    methods.add(inner.start("name"))
                    add("declaration", inner["name"], inner.start("name"), "method", name, False, _block_end(code, inner.end() - 1))
                if inner["name"] == "constructor":
                    for p in _INJECTED.finditer(inner["args"]):
                        add("injected", p["name"], inner.start("args") + p.start(), p["type"], name)
        if opened >= 0 and kind == "enum":
            for inner in _MEMBER_OF_ENUM.finditer(code, opened, end + 1):
                add("declaration", f"{name}.{inner['name']}", inner.start("name"), "enum-member", name, "export" in lead)
        if "export" in lead:
            add("export", "default" if "default" in lead else name, m.start(), "default" if "default" in lead else "local", None, True)
    for m in _IMPORT.finditer(bare):
        if code[m.start()] == " ":
            continue
        if m["bare"] is not None:
            add("import", None, m.start(), "side-effect", m["bare"])
            continue
        for imported, local in _bindings(m["what"]):
            add("import", local, m.start(), ("type:" if m["type"] else "") + imported, m["spec"])
    for pattern, how in ((_DYNAMIC, "dynamic"), (_REQUIRE, "require")):
        for m in pattern.finditer(bare):
            if code[m.start()] != " ":
                names = re.findall(_NAME, m["bound"]) if how == "require" and m["bound"] else [None]
                for name in names:
                    add("import", name, m.start(), how, m["spec"])
    for m in _EXPORT.finditer(bare):
        if code[m.start()] == " ":
            continue
        if m["what"].startswith("*"):
            add("export", m["what"].partition(" as ")[2].strip() or "*", m.start(), "star", m["spec"], True)
        else:
            for local, exported in _bindings(m["what"]):
                add("export", exported, m.start(), ("type:" if m["type"] else "") + local, m["spec"], True)
    for m in _DEFAULT.finditer(code):
        add("export", "default", m.start(), m["name"], None, True)
    for m in _COMMON.finditer(code):
        add("export", m["name"] or "default", m.start(), "commonjs", None, True)
    for m in _CALL.finditer(code):
        path = re.sub(r"\s", "", m["path"])
        if path in _NO_CALLS or m.start("path") in methods or re.search(r"\b(?:function\*?|class|interface)\s+$", code[max(0, m.start() - 12) : m.start("path")]):
            continue
        how = "constructor" if m["new"] else "tagged-template" if m["open"] == "`" else "member" if "." in path else "function"
        said = _ARGUMENT.match(bare, m.end()) if m["open"] == "(" else None
        add("call", path.replace("?.", ".").rpartition(".")[2], m.start("path"), how, path.replace("?.", "."), argument=said and (said["first"] or said["path"]))
        if m["open"] == "(" and re.match(r"[^()]*,?\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[\w$]+\s*=>)", code[m.end() : m.end() + 160]):
            add("callback", path.replace("?.", "."), m.start("path"), "function", None, argument=said and (said["first"] or said["path"]))
    for m in _MEMBER.finditer(code):
        path = m["path"].replace("?.", ".")
        add("member", path.rpartition(".")[2], m.start(), "env" if path.startswith("process.env.") else None, path)
    for m in _HERITAGE.finditer(code):
        for how, names in re.findall(r"\b(extends|implements)\s+((?:(?!\b(?:extends|implements)\b)[^{])+)", m["clauses"]):
            for name in re.sub(r"<[^<>]*>", "", names).split(","):
                if name := name.strip().partition(" ")[0].strip("(){}<>"):
                    add("heritage", m["name"], m.start(), how, name)
    for m in _TEST.finditer(bare):
        if code[m.start()] != " ":
            add("test", m["title"], m.start(), m["kind"], end=_closed(code, m.start()))
    for m in _TYPE.finditer(code):
        add("type", m["name"], m.start("name"))
    for m in _AMBIENT.finditer(bare):
        if code[m.start()] != " ":
            add("ambient", m["spec"], m.start(), None, m["spec"])
    for m in _UNION.finditer(code):
        for member in re.findall(_NAME, m["members"]):
            add("union", m["name"], m.start("name"), None, member)
    return sorted(out, key=lambda f: (f[5], f[6], f[0], f[1] or ""))


def _bindings(what: str) -> list[tuple[str, str]]:
    """(name there, name here) of an import or export clause."""
    out = []
    braces = re.search(r"\{([^}]*)\}", what)
    rest = what.replace(braces[0], "") if braces else what
    for part in rest.split(","):
        part = part.strip()
        if part.startswith("*"):
            out.append(("*", part.partition(" as ")[2].strip()))
        elif part:
            out.append(("default", part))
    for part in braces[1].split(",") if braces else ():
        a, _, b = (x.strip() for x in part.strip().removeprefix("type ").partition(" as "))
        if a:
            out.append((a, b or a))
    return out


#: What looks like a method in a class and isn't one.
_NO_METHODS = {"if", "for", "while", "switch", "catch", "constructor", "function", "return", "with"}


def _depth(code: str, start: int, at: int) -> int:
    part = code[start:at]
    return part.count("{") - part.count("}")


def _closed(code: str, at: int) -> int:
    """Where the call that begins at ``at`` ends."""
    depth = 0
    for m in re.finditer(r"[()]", code[at:]):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return at + m.start()
    return len(code)


def _block_end(code: str, at: int) -> int:
    """The end of the block that opens after a declaration, or of its line."""
    line_end = code.find("\n", at)
    opened = code.find("{", at, line_end if line_end >= 0 else len(code))
    if opened < 0:
        return line_end if line_end >= 0 else len(code)
    depth = 0
    for m in re.finditer(r"[{}]", code[opened:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return opened + m.start()
    return len(code)


def extract_facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, kind, name, detail, specifier, exported, line, col, end_line) of each fact; null and empty texts have none."""
    source = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).filter("text is not null")
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                found = facts_of(text)
                rows += found
                paths += [path] * len(found)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["path", *FACT_NAMES])

    return source.mapInArrow(run, f"path string, {FACT}")


def contained(facts: DataFrame) -> DataFrame:
    """Each call with the smallest declaration of its file around it, by an equi-join on the file and a range."""
    calls = facts.filter("kind = 'call'").select("path", F.col("name").alias("callee"), F.col("line").alias("at"), F.col("col").alias("at_col"), F.col("specifier").alias("callee_path"))
    around = facts.filter("kind = 'declaration' AND end_line >= line AND detail <> 'enum-member'").select("path", F.col("name").alias("owner"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    best = calls.join(around, "path").filter("at >= a AND at <= b").groupBy("path", "callee", "callee_path", "at", "at_col").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("size"), (-F.col("a")).alias("minus"), "owner")).alias("m"))
    return best.select("path", "callee", "callee_path", "at", F.col("m.owner").alias("owner"), (-F.col("m.minus")).alias("owner_line"))
