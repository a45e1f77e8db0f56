"""Source text: comment chunks, semantic chunks, symbols and imports of Python and script files.

Python rules follow line patterns and indentation; script files (ts, tsx, js, jsx) are read by patterns, an approximation
of a syntax tree. These run as Arrow maps over (file_path, content), file by file.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import content_id
from engram.session import ship

SCRIPTS = (".ts", ".tsx", ".js", ".jsx")
MAX_CHARS, OVERLAP, MIN_CLASS = 32_000, 2, 10
DEF = re.compile(r"^(\s*)def\s+([a-zA-Z_]\w*)\s*\(", re.ASCII)
CLASS = re.compile(r"^(\s*)class\s+([a-zA-Z_]\w*)\s*[:(]", re.ASCII)
SCRIPT_SYMBOL = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(function|class|interface|enum|type|const)\s+([A-Za-z_$][\w$]*)", re.M)
SCRIPT_IMPORT = re.compile(r"""^\s*(?:import|export)\s+(?:type\s+)?(?:([^'";]+?)\s+from\s+)?['"]([^'"]+)['"]""", re.M)
MARK = {"py": re.compile(r"#[^\n]*|'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)"), "script": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")}


def comment_chunks(path: str, text: str) -> list[tuple[str, int, int]]:
    """(code | comment | docstring, start, end): neighbours of one type are one chunk."""
    ext = posixpath.splitext(path)[1]
    mark = MARK["py"] if ext == ".py" else MARK["script"] if ext in SCRIPTS else None
    parts, at = [], 0
    for m in mark.finditer(text) if mark else ():
        if m.start() > at:
            parts.append(("code", at, m.start()))
        parts.append(("docstring" if m.group()[0] in "'\"" else "comment", m.start(), m.end()))
        at = m.end()
    if at < len(text) or not parts:
        parts.append(("code", at, len(text)))
    out: list[tuple[str, int, int]] = []
    for kind, a, b in parts:
        if out and out[-1][0] == kind and out[-1][2] == a:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def python_symbols(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, signature); a function lasts to the next def or class that isn't deeper, a
    class to the next such class."""
    lines = text.split("\n")
    heads = [(i, m, "class" if CLASS.match(x) else "function") for i, x in enumerate(lines) if (m := DEF.match(x) or CLASS.match(x))]
    out = []
    for k, (i, m, kind) in enumerate(heads):
        ends = (j for j, n, other in heads[k + 1 :] if len(n.group(1)) <= len(m.group(1)) and (kind == "function" or other == "class"))
        out.append((kind, m.group(2), i + 1, next(ends, len(lines)), lines[i].strip()))
    return out


def script_symbols(text: str) -> list[tuple[str, str, int, int, str]]:
    """Top-level declarations; one lasts to its closing brace, else to its line's end."""
    out = []
    for m in SCRIPT_SYMBOL.finditer(text):
        first = text.count("\n", 0, m.start(1)) + 1
        depth, end, seen = 0, text.find("\n", m.end()), False
        end = len(text) if end < 0 else end
        for b in re.finditer(r"[{};]", text[m.end() :]):
            if b.group() == ";" and not seen:
                end = m.end() + b.end()
                break
            depth += {"{": 1, "}": -1, ";": 0}[b.group()]
            seen = seen or b.group() == "{"
            if seen and depth <= 0:
                end = m.end() + b.end()
                break
        out.append((m.group(1), m.group(2), first, text.count("\n", 0, end) + 1, m.group().strip()))
    return out


def symbols_of(path: str, text: str) -> list[tuple[str, str, int, int, str]]:
    ext = posixpath.splitext(path)[1]
    return python_symbols(text) if ext == ".py" else script_symbols(text) if ext in SCRIPTS else []


def semantic_chunks(path: str, text: str) -> list[tuple[str, str, int, int]]:
    """(class | function | file, name, first line, last line): classes of ten lines or more, functions with two lines
    around, the file in parts of at most 32,000 characters that share two lines."""
    if not text:
        return []
    lines, out = text.split("\n"), []
    for kind, name, a, b, _ in symbols_of(path, text):
        if kind == "class" and b - a + 1 >= MIN_CLASS:
            out.append(("class", name, a, b))
    for kind, name, a, b, _ in symbols_of(path, text):
        if kind == "function":
            out.append(("function", name, max(1, a - OVERLAP), min(len(lines), b + OVERLAP)))
    start, size = 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) + 1 > MAX_CHARS:
            out.append(("file", path, start + 1, i))
            start = max(start + 1, i - OVERLAP)
            size = sum(len(y) + 1 for y in lines[start:i])
        size += len(x) + 1
    out.append(("file", path, start + 1, len(lines)))
    return out


def python_imports(path: str, text: str) -> list[tuple[str, str, int]]:
    """(module, name, line); relative modules by path from the file's folder."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        first, stmt = i, lines[i].split("#")[0]
        while (stmt.count("(") > stmt.count(")") or stmt.rstrip().endswith("\\")) and i + 1 < len(lines):
            i += 1
            stmt = stmt.rstrip().rstrip("\\") + " " + lines[i].split("#")[0]
        i += 1
        stmt = re.sub(r"[()\s]+", " ", stmt).strip().rstrip(",")
        if m := re.match(r"import (.+)$", stmt):
            out += [(x.split(" as ")[0].strip(), x.split(" as ")[0].strip(), first + 1) for x in m.group(1).split(",") if x.strip()]
        elif m := re.match(r"from (\.*)([\w.]*) import (.+)$", stmt):
            dots, module, names = m.groups()
            if dots:
                folder = posixpath.dirname(path)
                for _ in range(len(dots) - 1):
                    folder = posixpath.dirname(folder)
                module = "/".join(x for x in (folder, module.replace(".", "/")) if x)
            out += [(module, x.split(" as ")[0].strip(), first + 1) for x in names.split(",") if x.strip()]
    return out


def imports_of(path: str, text: str) -> list[tuple[str, str, int]]:
    ext = posixpath.splitext(path)[1]
    if ext == ".py":
        return python_imports(path, text)
    if ext not in SCRIPTS:
        return []
    found = []
    for m in SCRIPT_IMPORT.finditer(text):
        target = m.group(2)
        if target.startswith("."):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
        names = re.findall(r"[\w$*]+", re.sub(r"\bas\s+[\w$]+", "", m.group(1) or "*"))
        found += [(target, n, text.count("\n", 0, m.start()) + 1) for n in names]
    return found


def _each(files: DataFrame, fn, names: list[str], kinds: list[str]) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *({"string": pa.string(), "int": pa.int32()}[k] for k in kinds)]
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in fn(p or "", t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["file_path", *names])

    schema = "file_path string, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return files.select("file_path", "content").mapInArrow(run, schema)


def chunk_comments(files: DataFrame) -> DataFrame:
    return _each(files, comment_chunks, ["kind", "start", "end"], ["string", "int", "int"])


def chunk_semantic(files: DataFrame) -> DataFrame:
    """With content-addressed ids over path, kind, lines and the file's text hash."""
    c = _each(files, semantic_chunks, ["kind", "name", "first_line", "last_line"], ["string", "string", "int", "int"])
    return c.withColumn("chunk_id", content_id(F.col("file_path"), F.col("kind"), F.col("first_line"), F.col("last_line"), F.col("name")))


def extract_symbols(files: DataFrame) -> DataFrame:
    s = _each(files, symbols_of, ["kind", "name", "first_line", "last_line", "signature"], ["string", "string", "int", "int", "string"])
    return s.withColumn("symbol_id", content_id(F.col("file_path"), F.col("name"), F.col("kind"), F.col("first_line")))


def extract_imports(files: DataFrame) -> DataFrame:
    """Import edges; a target that is a file of the project (with a usual ending, or a package) is internal."""
    e = _each(files, imports_of, ["module", "name", "line"], ["string", "string", "int"])
    stem = F.regexp_replace(F.regexp_replace("file_path", r"\.(py|tsx?|jsx?)$", ""), r"/(__init__|index)$", "")
    known = files.select(stem.alias("stem"), F.col("file_path").alias("target")).groupBy("stem").agg(F.min("target").alias("target"))
    e = e.withColumn("stem", F.when(F.col("module").contains("/"), F.regexp_replace("module", r"\.(py|tsx?|jsx?)$", "")).otherwise(F.regexp_replace("module", r"\.", "/")))
    j = e.join(known, "stem", "left").drop("stem")
    target = F.coalesce("target", "module")
    return j.select("file_path", target.alias("target"), "name", "line", F.col("target").isNull().alias("is_external"), content_id(F.col("file_path"), F.lit("IMPORTS_FROM"), target, F.col("name")).alias("edge_id"))
