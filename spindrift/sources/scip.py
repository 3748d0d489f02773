"""SCIP indexes: decoding the wire format and turning occurrences into a graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.ids import file_id, symbol_id

#: Bounds of the input, and bits of an occurrence's roles.
MOST_BYTES, MOST_STRING, MOST_DEPTH = 64 << 20, 1 << 20, 64
MOST_DOCUMENTS, MOST_RECORDS = 100_000, 1_000_000
DEFINITION, IMPORT = 1, 2
#: Field numbers of Index, Document, Occurrence and SymbolInformation.
INDEX_DOCUMENT, INDEX_EXTERNAL = 2, 3
DOCUMENT_PATH, DOCUMENT_OCCURRENCE, DOCUMENT_SYMBOL, DOCUMENT_LANGUAGE = 1, 2, 3, 4
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES = 1, 2, 3
SYMBOL_NAME, SYMBOL_DISPLAY = 1, 6

RECORDS = "source string, doc int, path string, language string, what string, symbol string, display string, range array<int>, roles int"


class Malformed(ValueError):
    pass


def _varint(b: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise Malformed("broken number")
        byte = b[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(b: memoryview) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a message; groups are refused."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        field, wire = key >> 3, key & 7
        if not field:
            raise Malformed("field 0")
        if wire == 0:
            value, at = _varint(b, at)
        elif wire == 2:
            n, at = _varint(b, at)
            if at + n > len(b):
                raise Malformed("truncated")
            value, at = b[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            if at + n > len(b):
                raise Malformed("truncated")
            value, at = b[at : at + n], at + n
        else:
            raise Malformed(f"wire type {wire}")
        yield field, wire, value


def _text(wire: int, value) -> str:
    if wire != 2 or len(value) > MOST_STRING:
        raise Malformed("not a string of allowed length")
    try:
        return bytes(value).decode()
    except UnicodeDecodeError as e:
        raise Malformed("invalid UTF-8") from e


def _int32(value: int) -> int:
    low = value & 0xFFFFFFFF
    return low - (1 << 32) if low >> 31 else low


def _occurrence(b: memoryview) -> tuple[str, list[int], int]:
    symbol, at, roles = "", [], 0
    for field, wire, value in fields(b):
        if field == OCCURRENCE_RANGE and wire == 0:
            at.append(_int32(value))
        elif field == OCCURRENCE_RANGE and wire == 2:
            i = 0
            while i < len(value):
                n, i = _varint(value, i)
                at.append(_int32(n))
        elif field == OCCURRENCE_SYMBOL:
            symbol = _text(wire, value)
        elif field == OCCURRENCE_ROLES and wire == 0:
            roles = _int32(value)
        if len(at) > 4:
            raise Malformed("range of more than four numbers")
    return symbol, at, roles


def _information(b: memoryview) -> tuple[str, str]:
    symbol = display = ""
    for field, wire, value in fields(b):
        if field == SYMBOL_NAME:
            symbol = _text(wire, value)
        elif field == SYMBOL_DISPLAY:
            display = _text(wire, value)
    return symbol, display


def decoded(raw: bytes) -> list[tuple]:
    """Rows of :data:`RECORDS` without the source."""
    if len(raw) > MOST_BYTES:
        raise Malformed("input too large")
    out, n_documents = [], 0
    for field, wire, value in fields(memoryview(raw)):
        if field != INDEX_DOCUMENT:
            continue
        if wire != 2 or n_documents >= MOST_DOCUMENTS:
            raise Malformed("documents")
        path = language = ""
        occurrences, infos = [], []
        for f, w, v in fields(value):
            if f == DOCUMENT_PATH:
                path = _text(w, v)
            elif f == DOCUMENT_LANGUAGE:
                language = _text(w, v)
            elif f in (DOCUMENT_OCCURRENCE, DOCUMENT_SYMBOL):
                if w != 2 or len(occurrences) + len(infos) >= MOST_RECORDS:
                    raise Malformed("records")
                (occurrences.append(_occurrence(v)) if f == DOCUMENT_OCCURRENCE else infos.append(_information(v)))
        out += [(n_documents, path, language, "occurrence", s, None, r, roles) for s, r, roles in occurrences]
        out += [(n_documents, path, language, "symbol", s, d, None, None) for s, d in infos]
        n_documents += 1
    return out


def scip_records(indexes: DataFrame) -> DataFrame:
    """Occurrences and symbols of encoded indexes (source, content); malformed input fails."""

    def run(frames):
        for f in frames:
            rows = [(r.source, *x) for r in f.itertuples() for x in decoded(bytes(r.content))]
            yield pd.DataFrame(rows, columns=["source", "doc", "path", "language", "what", "symbol", "display", "range", "roles"]).astype({"doc": "Int32", "roles": "Int32"})

    return indexes.mapInPandas(run, RECORDS)


def line_range(r: Column) -> Column:
    """(start_line, end_line) from 1, inclusive, of a half-open range from 0.

    Three numbers are line, start, end; four are line, start, line, end. An end
    at the beginning of a line does not reach into it. A malformed range fails.
    """
    g = lambda i: F.get(r, F.lit(i))
    a, ac = g(0), g(1)
    b, bc = F.when(F.size(r) == 3, g(0)).otherwise(g(2)), F.when(F.size(r) == 3, g(2)).otherwise(g(3))
    bad = ~F.size(r).isin(3, 4) | (a < 0) | (ac < 0) | (b < 0) | (bc < 0) | (a > b) | ((a == b) & (ac > bc))
    fail = F.raise_error(F.lit("invalid source range")).cast("struct<start_line:int,end_line:int>")
    return F.when(F.coalesce(bad, F.lit(True)), fail).otherwise(
        F.struct((a + 1).cast("int").alias("start_line"), F.when((a < b) & (bc == 0), b).otherwise(b + 1).cast("int").alias("end_line")))


def symbol_key(path: Column, symbol: Column) -> Column:
    return F.when(symbol.startswith("local "), F.concat_ws(":", path, symbol)).otherwise(symbol)


def imported(records: DataFrame, repository: str) -> dict[str, DataFrame]:
    """symbols, edges and unresolved external symbols of decoded records."""
    repo = F.lit(repository)
    r = records.withColumn("key", symbol_key(F.col("path"), F.col("symbol")))
    occ = r.filter("what = 'occurrence' AND symbol <> ''").withColumn("lines", line_range(F.col("range")))
    is_def = F.col("roles").bitwiseAND(DEFINITION) != 0
    defs = occ.filter(is_def).groupBy("source", "doc", "symbol").agg(F.min("lines").alias("lines"))
    info = r.filter("what = 'symbol' AND symbol <> ''").join(defs, ["source", "doc", "symbol"])
    symbols = info.select(
        "source", "key", symbol_id(repo, F.col("language"), F.col("key")).alias("symbol_id"), F.when(F.coalesce("display", F.lit("")) == "", F.col("symbol")).otherwise(F.col("display")).alias("name"),
        file_id(repo, F.col("path")).alias("file_id"), "lines.start_line", "lines.end_line").distinct()
    known = symbols.groupBy("source", "key").agg(F.min("symbol_id").alias("symbol_id"))
    kind = F.when(is_def, "defines").when(F.col("roles").bitwiseAND(IMPORT) != 0, "imports").otherwise("references")
    edges = occ.join(known, ["source", "key"], "left").select(
        "source", kind.alias("edge_kind"), file_id(repo, F.col("path")).alias("source_id"), F.coalesce("symbol_id", "symbol").alias("target"), F.col("symbol_id").isNull().alias("target_is_external"),
        F.col("lines.start_line").alias("source_line"))
    unresolved = edges.filter("edge_kind <> 'defines' AND target_is_external AND NOT startswith(target, 'local ')").select("source", "target").distinct()
    return {"symbols": symbols.drop("key"), "edges": edges, "unresolved": unresolved}
