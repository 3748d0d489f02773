"""From file contents to chunks, symbols, edges and diagnostics."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.ids import chunk_id, symbol_id
from spindrift.functions.text import line_excerpt
from spindrift.tables import arrow_batches

#: Fixed value: most bytes of a chunk.
CHUNK_BYTES = 8192

FOUND = "generation_id string, file_id string, what string, ordinal int, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, text string"


def chunked(source: str, most: int = CHUNK_BYTES) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text) of the runs of lines that are not blank.

    A run ends before the line that would make it longer than ``most`` bytes;
    that line stands by itself, divided between characters if need be. A text
    without any such line gives one empty chunk.
    """
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    size = first = 0

    def close(last: int) -> None:
        nonlocal size
        if run:
            out.append((first, max(first, last), "".join(run)))
            run.clear()
            size = 0

    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", source)
    for number, line in enumerate(lines, 1):
        n = len(line.encode())
        if not line.strip():
            close(number - 1)
        elif size + n <= most:
            if not run:
                first = number
            run.append(line)
            size += n
        else:
            close(number - 1)
            raw = line.encode()
            at = 0
            while at < len(raw):
                end = min(at + most, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                out.append((number, number, raw[at:end].decode()))
                at = end
    close(len(lines))
    return out or [(1, 1, "")]


def python_declarations(source: str) -> list[tuple]:
    """(what, name, kind, start_line, end_line) of a Python source by its syntax tree."""
    tree = ast.parse(source)
    out: list[tuple] = []
    bound: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("symbol", node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno))
            bound.add(node.name)
        elif isinstance(node, ast.Import):
            out += [("imports", a.name, None, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("imports", f"{node.module or ''}.{a.name}".strip("."), None, node.lineno, node.lineno) for a in node.names]
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if name:
                out.append(("calls", name, None, node.lineno, node.lineno))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            out.append(("references", node.id, None, node.lineno, node.lineno))
    return out


#: Lines that declare, import or call, in languages without a parser here.
_DECLARES = re.compile(
    r"^[ \t]*(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|static|final|abstract|async|unsafe|override|open|data|sealed|const|inline|extern)\s+)*"
    r"(?P<kind>fn|func|fun|def|function|class|struct|enum|trait|interface|module|mod|type|impl|protocol|object|record|union|namespace)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)", re.M)
_C_FUNCTION = re.compile(r"^(?:static\s+|inline\s+|const\s+)*[A-Za-z_][\w*]*[\s*]+(?P<name>[A-Za-z_]\w*)\s*\([^;{]*\)\s*\{", re.M)
_IMPORTS = re.compile(r"^[ \t]*(?:#include\s*[<\"](?P<a>[^>\"]+)|(?:import|use|using|require|from)\s*\(?\s*[\"']?(?P<b>[\w./:*{}, -]+))|\brequire\(\s*[\"'](?P<c>[^\"']+)", re.M)
_CALLS = re.compile(r"\b([A-Za-z_]\w*)\s*!?\(")
_NAME = re.compile(r"\b[A-Za-z_]\w*\b")
_KEYWORDS = frozenset(
    "if else for while switch match return fn func fun def function class struct enum trait interface new in of let const var val mut pub use import from static "
    "void int long double float bool true false null None True False self this try catch except finally raise throw async await do end then elif not and or is as "
    "package namespace using public private protected impl type where loop break continue default case sizeof".split())


def declarations(language: str | None, source: str) -> list[tuple] | None:
    """Declarations of a source; None for an unknown language. May raise SyntaxError.

    Python is read by its syntax tree, other languages by the shape of lines.
    """
    if language is None:
        return None
    if language == "python":
        return python_declarations(source)
    if source.count("{") != source.count("}") and language not in ("ruby",):
        raise SyntaxError("unbalanced braces")
    starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(at: int) -> int:
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
        return lo + 1

    out: list[tuple] = []
    declared: set[int] = set()
    for pattern in (_DECLARES, _C_FUNCTION) if language in ("c", "cpp", "java", "csharp") else (_DECLARES,):
        for m in pattern.finditer(source):
            if m.start("name") in declared or m["name"] in _KEYWORDS:
                continue
            declared.add(m.start("name"))
            first = line(m.start("name"))
            out.append(("symbol", m["name"], m.groupdict().get("kind") or "function", first, _block_end(source, m.end(), first, line)))
    imported: set[int] = set()
    for m in _IMPORTS.finditer(source):
        target = next(x for x in m.groups() if x is not None).strip().rstrip(";")
        if target:
            imported.add(line(m.start()))
            out.append(("imports", target, None, line(m.start()), line(m.start())))
    for m in _CALLS.finditer(source):
        if m.start(1) not in declared and m[1] not in _KEYWORDS:
            out.append(("calls", m[1], None, line(m.start()), line(m.start())))
    for m in _NAME.finditer(source):
        n = line(m.start())
        if m.start() not in declared and n not in imported and m[0] not in _KEYWORDS:
            out.append(("references", m[0], None, n, n))
    return out


def _block_end(source: str, at: int, first: int, line) -> int:
    """Line on which the block after a declaration closes."""
    depth = 0
    for m in re.finditer(r"[{};]", source[at:]):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return line(at + m.start())
        elif depth == 0:
            break
    return first


def _extracting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in FOUND.split(", ")]
    for f in frames:
        out = []
        for r in f.itertuples():
            text = r.content or ""
            for i, (a, b, t) in enumerate(chunked(text)):
                out.append((r.generation_id, r.file_id, "chunk", i, None, None, a, b, 0, 0, t))
            try:
                found = declarations(r.language if isinstance(r.language, str) else None, text)
                problem = "unknown_language" if found is None else None
            except (SyntaxError, ValueError, RecursionError) as e:
                found, problem = None, f"parse_error: {e}"
            if problem:
                out.append((r.generation_id, r.file_id, "diagnostic", 0, problem.split(":")[0], problem, 1, 1, 0, 0, None))
            for i, (what, name, kind, a, b) in enumerate(found or []):
                out.append((r.generation_id, r.file_id, what, i, name, kind, a, b, 0, 0, None))
        yield pd.DataFrame(out, columns=columns)


def extracted(files: DataFrame) -> DataFrame:
    """What was found in each file (:data:`FOUND`), in one pass.

    ``files``: generation_id, file_id, language, content. A file of an unknown
    language or with a syntax error gives its chunks and one diagnostic.
    """
    arrow_batches(files.sparkSession, 500)
    return files.select("generation_id", "file_id", "language", "content").mapInPandas(_extracting, FOUND)


def graph_tables(files: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """chunks, symbols, edges and diagnostics of a generation.

    ``files``: generation_id, file_id, repository_id, path, language. Chunks and
    symbols hang on their file by ``contains`` and ``defines``; imports, calls
    and references point to text outside the graph.
    """
    f = files.select("generation_id", "file_id", "repository_id", "path", "language")
    digest = F.sha2("text", 256)
    chunks = found.filter("what = 'chunk'").select(
        chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"), F.col("ordinal"), digest).alias("chunk_id"), "file_id", "generation_id", "start_line", "end_line", "text", digest.alias("content_digest"))
    symbols = found.filter("what = 'symbol'").join(f, ["generation_id", "file_id"]).select(
        "generation_id", symbol_id(F.col("repository_id"), F.coalesce("language", F.lit("")), F.concat_ws(":", "path", "name", F.concat_ws("-", "start_line", "end_line"))).alias("symbol_id"),
        "file_id", "name", F.col("kind").alias("symbol_kind"), "start_line", "end_line").distinct()
    external = found.filter("what IN ('imports', 'calls', 'references')").select(
        "generation_id", F.col("what").alias("edge_kind"), F.col("file_id").alias("source_id"), F.col("name").alias("target"), F.lit(True).alias("target_is_external"), F.col("start_line").alias("source_line"))
    inner = (
        chunks.select("generation_id", F.lit("contains").alias("edge_kind"), F.col("file_id").alias("source_id"), F.col("chunk_id").alias("target"), F.lit(False).alias("target_is_external"), F.col("start_line").alias("source_line"))
        .unionByName(symbols.select("generation_id", F.lit("defines").alias("edge_kind"), F.col("file_id").alias("source_id"), F.col("symbol_id").alias("target"), F.lit(False).alias("target_is_external"), F.col("start_line").alias("source_line")))
    )
    diagnostics = found.filter("what = 'diagnostic'").join(f, ["generation_id", "file_id"]).select("generation_id", "path", F.col("name").alias("code"), F.substring("kind", 1, 1024).alias("message")).distinct()
    return {"chunks": chunks, "symbols": symbols, "edges": inner.unionByName(external).distinct(), "diagnostics": diagnostics}


def lexical_documents(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Documents of the lexical index: each chunk, and each symbol with its lines."""
    f = files.select("generation_id", "file_id", F.col("repository_id").alias("repository"), "revision", "path", "language", "content")
    c = chunks.join(f.drop("content"), ["generation_id", "file_id"]).select(
        F.col("chunk_id").alias("entity_id"), "repository", "revision", "path", "language", F.lit(None).cast("string").alias("symbol"), F.col("text").alias("body"), "start_line", "end_line", F.lit("chunk").alias("kind"))
    s = symbols.join(f, ["generation_id", "file_id"]).select(
        F.col("symbol_id").alias("entity_id"), "repository", "revision", "path", "language", F.col("name").alias("symbol"),
        line_excerpt(F.col("content"), F.col("start_line"), F.col("end_line")).alias("body"), "start_line", "end_line", F.lit("symbol").alias("kind"))
    return c.unionByName(s)


def snapshot_diagnostics(files: DataFrame, generation_id: str) -> DataFrame:
    """A diagnostic for each file that was not read."""
    return files.filter("skip_reason IS NOT NULL").select(
        F.lit(generation_id).alias("generation_id"), "path", F.col("skip_reason").alias("code"), F.concat(F.lit("skipped: "), F.col("skip_reason")).alias("message"))


def content_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
