"""Notes: Markdown with front matter, claims and managed regions.

Keys of the front matter and markers of regions carry a name, so that notes of
different tools can live together; it is a parameter of every function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.excerpts import patched, unquoted
from spindrift.operators.claims import REVIEWS, STATUSES

NAME = "spindrift"
#: Bounds of a folder of notes; reviews that notes may state besides.
MOST_BYTES = 4 << 20
NOTE_REVIEWS = (*REVIEWS, "agent_generated", "human_reviewed")

CLAIMS = (
    "note_path string, note_id string, title string, claim_id string, status string, review string, region_start int, region_end int, body string, "
    "anchors array<struct<repo:string,path:string,symbol:string,confidence:double,provenance:string>>, error string")


class NoteError(ValueError):
    """A note that does not keep to the format; the text names the fault first."""


@dataclass
class Claim:
    status: str
    review: str
    anchors: list[dict]
    sources: dict[str, str]
    status_at: tuple[int, int] | None = None
    review_at: tuple[int, int] | None = None
    region: tuple[int, int] = (0, 0)


@dataclass
class Note:
    raw: bytes
    id: str
    title: str
    schema: int
    claims: dict[str, Claim] = field(default_factory=dict)

    def body(self, claim_id: str) -> str:
        a, b = self.claims[claim_id].region
        return self.raw[a:b].decode()

    def with_patch(self, claim_id: str, body: str | None = None, status: str | None = None, review: str | None = None) -> bytes:
        """The note with a claim's body, status or review replaced; other bytes stay."""
        if claim_id not in self.claims:
            raise NoteError(f"claim_not_found: {claim_id}")
        c, edits = self.claims[claim_id], []
        for at, new in ((c.region, body), (c.status_at, status), (c.review_at, review)):
            if new is not None:
                if at is None:
                    raise NoteError("malformed_frontmatter: no place for the value")
                edits.append((*at, new.encode()))
        return patched(self.raw, edits)


def front_matter(raw: bytes) -> tuple[int, int, int]:
    """Start and end of the front matter, and start of the body, in bytes."""
    lines = raw.splitlines(keepends=True)
    if not lines or lines[0].rstrip(b"\r\n") != b"---":
        raise NoteError("missing_frontmatter: the first line is not ---")
    start = at = len(lines[0])
    for line in lines[1:]:
        if line.rstrip(b"\r\n") == b"---":
            return start, at, at + len(line)
        at += len(line)
    raise NoteError("unclosed_frontmatter: no second ---")


@dataclass
class _Line:
    indent: int
    text: str
    at: int  # offset of the text in bytes


def _lines(block: bytes, base: int) -> list[_Line]:
    out, at = [], base
    for raw in block.splitlines(keepends=True):
        line = raw.rstrip(b"\r\n")
        text = line.lstrip(b" ")
        if text.strip() and not text.startswith(b"#"):
            out.append(_Line(len(line) - len(text), text.decode(), at + len(line) - len(text)))
        at += len(raw)
    return out


def _value(lines: list[_Line], i: int, indent: int, spots: dict[int, tuple[int, int]]):
    """Maps, lists and scalars of the block that begins at line ``i``."""
    if lines[i].text.startswith("- ") or lines[i].text == "-":
        out: list = []
        while i < len(lines) and lines[i].indent == indent and (lines[i].text.startswith("- ") or lines[i].text == "-"):
            inner = lines[i].text[1:].lstrip()
            step = len(lines[i].text) - len(inner)
            if ":" in inner and not inner.startswith(("'", '"')):
                lines[i] = _Line(indent + step, inner, lines[i].at + step)
                value, i = _value(lines, i, indent + step, spots)
            else:
                value, i = unquoted(inner), i + 1
            out.append(value)
        return out, i
    result: dict = {}
    while i < len(lines) and lines[i].indent == indent:
        m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*))?$", lines[i].text)
        if not m:
            raise NoteError(f"malformed_frontmatter: {lines[i].text[:80]}")
        key, rest = unquoted(m[1]), (m[2] or "").strip()
        if rest and rest not in ("{}", "[]"):
            start = lines[i].at + len(lines[i].text[: m.start(2)].encode())
            result[key] = unquoted(re.sub(r"\s+#.*$", "", rest) if rest[0] not in "'\"" else rest)
            spots[id(result), key] = (start, start + len(rest.encode()))
            i += 1
        elif i + 1 < len(lines) and (lines[i + 1].indent > indent or (lines[i + 1].indent == indent and lines[i + 1].text.startswith("- "))):
            result[key], i = _value(lines, i + 1, lines[i + 1].indent, spots)
        else:
            result[key], i = ({} if rest == "{}" else [] if rest == "[]" else None), i + 1
    if i < len(lines) and lines[i].indent > indent:
        raise NoteError(f"malformed_frontmatter: {lines[i].text[:80]}")
    return result, i


def _anchors(value: dict) -> list[dict]:
    out = []
    for kind in ("explicit", "inferred"):
        for a in (value or {}).get(kind) or []:
            if not all(a.get(k) for k in ("repo", "path", "symbol")):
                raise NoteError("malformed_frontmatter: an anchor needs repo, path and symbol")
            confidence = None
            if kind == "inferred":
                try:
                    confidence = float(a["confidence"])
                except (KeyError, ValueError) as e:
                    raise NoteError("malformed_frontmatter: an inferred anchor needs a confidence") from e
            out.append({"repo": a["repo"], "path": a["path"], "symbol": a["symbol"], "confidence": confidence, "provenance": a.get("provenance")})
    return out


def parse_note(text: str | bytes, name: str = NAME) -> Note:
    """A note from its text; raises :class:`NoteError` with the first fault."""
    raw = text.encode() if isinstance(text, str) else bytes(text)
    start, end, body = front_matter(raw)
    spots: dict = {}
    lines = _lines(raw[start:end], start)
    top, rest = _value(lines, 0, lines[0].indent, spots) if lines else ({}, 0)
    if not isinstance(top, dict) or rest != len(lines):
        raise NoteError("malformed_frontmatter: not a map")
    try:
        schema = int(top[f"{name}_schema"])
    except (KeyError, ValueError, TypeError) as e:
        raise NoteError(f"malformed_frontmatter: {name}_schema must be an integer") from e
    if not isinstance(top.get(f"{name}_id"), str):
        raise NoteError(f"malformed_frontmatter: {name}_id is missing")
    note = Note(raw, top[f"{name}_id"], top.get("title") or "", schema)
    for claim_id, c in (top.get(f"{name}_claims") or {}).items():
        c = c or {}
        if c.get("status") not in STATUSES:
            raise NoteError(f"unknown_status: {c.get('status')}")
        if c.get("review") not in NOTE_REVIEWS:
            raise NoteError(f"unknown_review: {c.get('review')}")
        sources = {k: (v or {}).get("revision") for k, v in (c.get("sources") or {}).items()}
        note.claims[claim_id] = Claim(c["status"], c["review"], _anchors(c.get("anchors")), sources, spots.get((id(c), "status")), spots.get((id(c), "review")))
    _regions(note, body, name)
    return note


def _regions(note: Note, body: int, name: str) -> None:
    opening, closing = f"<!-- {name}:managed claim=", f"<!-- /{name}:managed -->"
    found: dict[str, tuple[int, int]] = {}
    current: tuple[str, int] | None = None
    at = body
    for line in note.raw[body:].splitlines(keepends=True):
        mark = line.decode().strip()
        if mark.startswith(opening):
            if current or not mark.endswith("-->"):
                raise NoteError("malformed_marker: a region opens within another, or is not closed by -->")
            claim_id = mark[len(opening) : -3].strip()
            if claim_id not in note.claims:
                raise NoteError(f"unknown_claim: {claim_id}")
            current = (claim_id, at + len(line))
        elif mark == closing:
            if not current:
                raise NoteError("malformed_marker: a region closes that is not open")
            if current[0] in found:
                raise NoteError(f"duplicate_region: {current[0]}")
            found[current[0]] = (current[1], at)
            current = None
        at += len(line)
    if current:
        raise NoteError(f"unclosed_region: {current[0]}")
    for claim_id, c in note.claims.items():
        if claim_id not in found:
            raise NoteError(f"missing_region: {claim_id}")
        c.region = found[claim_id]


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(note_path, text) of the Markdown files in a folder, in the order of paths; those above 4 MiB are skipped."""
    notes = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("note_path"), F.col("value").alias("text"))
    return notes.filter(F.octet_length("text") <= MOST_BYTES).orderBy("note_path")


def skipped_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(note_path, reason) of the notes that :func:`read_notes` passes over, told by their length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).filter(F.col("length") > MOST_BYTES)
    return files.select(F.col("path").alias("note_path"), F.lit("too_large").alias("reason"))


def claims_of(notes: DataFrame, name: str = NAME) -> DataFrame:
    """One row for each claim (:data:`CLAIMS`); a faulty note gives one row with ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.split(r", (?=\w+ \w)", CLAIMS)]
        for f in frames:
            out = []
            for path, text in zip(f.note_path, f.text):
                try:
                    n = parse_note(text or "", name)
                except (NoteError, UnicodeDecodeError) as e:
                    out.append((path, *[None] * (len(columns) - 2), str(e)))
                    continue
                out += [(path, n.id, n.title, k, c.status, c.review, *c.region, n.body(k), c.anchors, None) for k, c in sorted(n.claims.items())]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"region_start": "Int32", "region_end": "Int32"})

    return notes.select("note_path", "text").mapInPandas(run, CLAIMS)


PERSONAL = "note_id string, title string, text string"


def personal_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Personal notes (note_id, title, text) in the order of their ids."""
    raw = spark.read.option("pathGlobFilter", "note_*.md").text(folder, wholetext=True).select("value")
    key = lambda k: F.regexp_extract("value", rf"(?m)^(?:\w+_)?{k}: *\"?(.*?)\"? *\r?$", 1)
    return raw.select(key("id").alias("note_id"), F.regexp_replace(key("title"), r"\\(.)", "$1").alias("title"), F.col("value").alias("text")).orderBy("note_id")
