"""Splitting oversized texts at natural boundaries.

A text is cut into byte ranges with halos; workers list the boundaries of their
range that a cut may need, and count its line ends; the boundary tables are
stitched in order into a plan of pieces; line numbers come from prefix sums over
the ranges; and the pieces are emitted by offset from the range they start in.
What the stitching of one text reads is a few per cent of it, since a boundary is
left out where better ones lie closer together than any piece can look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.tables import arrow_batches, shuffle_parts

LIMIT = 8192
OVERLAP = 256
RANGE = 1 << 20
LEFT_HALO = 256

#: Boundary classes, the better the higher.
WORD, SENTENCE, STATEMENT, LINE, BLANK = range(5)

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes after which a closing brace does not end a statement: ) , . ; ] }
_INNER = np.frombuffer(b"),.;]}", np.uint8)

CUTS = "item string, version long, n_bytes long, range_no long, until long, n_lines long, offsets binary, classes binary"
PLAN = "item string, version long, range_no long, piece_no int, start_byte long, end_byte long, overlap_bytes int"
PIECES = "item string, version long, piece_no int, start_byte long, end_byte long, overlap_bytes int, start_line int, end_line int, text string"


def boundaries(body: bytes, origin: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in ``(begin, end]`` after which a text may be cut, with classes.

    ``body`` holds the bytes from ``origin`` on, and reaches a little beyond
    ``end`` unless the text ends. A line end is the byte 10, so CR LF stays
    together. A blank line holds white space only. Statements end with ``;`` or
    ``}`` (unless punctuation follows that goes on with the statement), sentences
    with ``.``, ``!`` or ``?`` before white space.
    """
    b = np.frombuffer(body, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    white = _WHITE[b]
    follows = np.append(white[1:], True)
    kind = np.full(len(b), -1, np.int8)
    kind[white & ~follows] = WORD
    kind[np.isin(b, (46, 33, 63)) & follows] = SENTENCE
    after = np.append(b[1:], np.uint8(32))
    kind[(b == 59) | ((b == 125) & ~np.isin(after, _INNER))] = STATEMENT
    ends = np.flatnonzero(b == 10)
    kind[ends] = LINE
    ink = np.cumsum(~white)
    kind[ends[1:][ink[ends[1:]] == ink[ends[:-1]]]] = BLANK
    at = np.flatnonzero(kind >= 0)
    offset = at + origin + 1
    inside = (offset > begin) & (offset <= end)
    return offset[inside].astype(np.int64), kind[at[inside]]


def needed(offsets: np.ndarray, classes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries that a cut may use.

    A boundary is used only where none of a better class lies in the half of a
    piece that is searched, which takes ``limit`` / 2 - 8 bytes or more. Between
    better ones that are closer it is left out; before the first and behind the
    last better one of a range it stays.
    """
    keep = np.ones(len(offsets), bool)
    for c in (WORD, SENTENCE, STATEMENT, LINE):
        own, better = np.flatnonzero(classes == c), offsets[classes > c]
        if len(own) and len(better):
            at = np.searchsorted(better, offsets[own])
            inside = (at > 0) & (at < len(better))
            gap = better[np.minimum(at, len(better) - 1)] - better[np.maximum(at, 1) - 1]
            keep[own[inside & (gap < limit // 2 - 8)]] = False
    return offsets[keep], classes[keep]


class Planner:
    """Greedy cuts over a text whose boundaries arrive range by range."""

    def __init__(self, n_bytes: int, limit: int, overlap: int):
        # A cut or overlap inside a character moves back by up to three bytes.
        self.n, self.most, self.overlap = n_bytes, limit - 4, overlap
        self.offsets, self.classes = np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.start, self.shared, self.number = 0, 0, 0

    def feed(self, offsets: np.ndarray, classes: np.ndarray, until: int) -> Iterator[tuple]:
        self.offsets = np.concatenate([self.offsets, offsets])
        self.classes = np.concatenate([self.classes, classes])
        while self.start < self.n and (until >= self.n or self.start + self.most <= until):
            end, natural = self._end()
            self.number += 1
            yield self.number, self.start, end, self.shared
            if end >= self.n:
                self.start = self.n
                return
            # A cut that may still move back to the start of a character must
            # not shorten what the next piece repeats.
            self.shared = min(self.overlap + (0 if natural or not self.overlap else 3), end - self.start - 1)
            self.start = end - self.shared
            k = np.searchsorted(self.offsets, self.start, "right")
            self.offsets, self.classes = self.offsets[k:], self.classes[k:]

    def _end(self) -> tuple[int, bool]:
        last = self.start + self.most
        if self.n <= last:
            return self.n, True
        floor = self.start + self.shared + self.overlap + 1
        half = max(floor, self.start + self.most // 2)
        for low, high in ((half, last), (floor, half)):
            i, j = np.searchsorted(self.offsets, [low, high], "right")
            for least in (BLANK, LINE, STATEMENT, SENTENCE):
                hit = np.flatnonzero(self.classes[i:j] >= least)
                if len(hit):
                    return int(self.offsets[i + hit[-1]]), True
        i, j = np.searchsorted(self.offsets, [floor, last], "right")
        return (int(self.offsets[j - 1]), True) if j > i else (last, False)


def _detecting(limit: int):
    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [needed(*boundaries(bytes(r.body), r.origin, r.begin, r.until), limit) for r in f.itertuples()]
            lines = [bytes(r.body)[r.begin - r.origin : r.until - r.origin].count(b"\n") for r in f.itertuples()]
            # Offsets count from the begin of the range, which keeps them short.
            yield f[["item", "version", "n_bytes", "range_no", "until"]].assign(
                n_lines=lines, offsets=[(o - begin).astype(np.int32).tobytes() for (o, _), begin in zip(found, f.begin)], classes=[c.tobytes() for _, c in found])

    return detect


def _planning(limit: int, overlap: int, width: int):
    def stitch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, planner = None, None
        for f in frames:
            out = []
            for r in f.itertuples():
                if key != (r.item, r.version):
                    key, planner = (r.item, r.version), Planner(r.n_bytes, limit, overlap)
                offsets = np.frombuffer(r.offsets, np.int32).astype(np.int64) + r.range_no * width
                for p in planner.feed(offsets, np.frombuffer(r.classes, np.int8), r.until):
                    out.append((r.item, r.version, p[1] // width, *p))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    return stitch


def _aligned(body: bytes, at: int) -> int:
    """The offset, moved back to the first byte of a character."""
    while 0 < at < len(body) and (body[at] & 0xC0) == 0x80:
        at -= 1
    return at


def _emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            body = bytes(r.body)
            at, line = r.begin - r.origin, r.base_line + r.lines_before
            for p in sorted(r.plan, key=lambda p: p["piece_no"]):
                a, b = _aligned(body, p["start_byte"] - r.origin), _aligned(body, p["end_byte"] - r.origin)
                shared = 0 if not p["overlap_bytes"] else _aligned(body, p["start_byte"] + p["overlap_bytes"] - r.origin) - a
                # Pieces come in order; a line end that closes a piece does not begin another line of it.
                line += body.count(b"\n", at, a) if a >= at else -body.count(b"\n", a, at)
                at = a
                out.append((r.item, r.version, p["piece_no"], a + r.origin, b + r.origin, shared, line, line + body.count(b"\n", a, b - 1), body[a:b].decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", start_line_col: str = "start_line",
                    limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """Pieces of every text that takes more than ``limit`` bytes in UTF-8.

    Result: item (the id), version (hash of the text), piece_no (from 1),
    start_byte, end_byte, overlap_bytes, start_line, end_line, text.

    * Every piece has at most ``limit`` bytes. It ends after a blank line, else
      a line end, else a statement, else a sentence, looked for in the second
      half of what it may hold and then in the first; without any of these after
      a word, and in a text without white space between two characters.
    * Each piece but the first begins with the last ``overlap`` bytes of its
      predecessor, up to three more where that would divide a character, and up
      to six if the predecessor had to end between two characters.
    * Lines count from start_line; null or less than 1 counts as 1. A stated
      end_line is not used. A piece that ends with a line end does not reach
      into the next line.
    * Repeated rows give one set of pieces; one id with different texts gives a
      set for each, told apart by ``version``. Null ids, null texts and texts
      within the limit give nothing.
    """
    if not 0 <= overlap <= limit // 4 or limit < 64 or range_bytes < limit:
        raise ValueError("needs limit >= 64, 0 <= overlap <= limit / 4 and range_bytes >= limit")
    arrow_batches(df.sparkSession, 64)
    parts = shuffle_parts(df.sparkSession)
    begin = F.col("range_no") * F.lit(range_bytes)
    ranges = (
        df.filter(F.octet_length(text_col) > limit)
        .filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("version"),
                F.when(F.col(start_line_col) >= 1, F.col(start_line_col)).otherwise(1).cast("int").alias("base_line"),
                F.octet_length(text_col).cast("long").alias("n_bytes"), F.encode(text_col, "UTF-8").alias("whole"))
        .withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - 1) div {range_bytes}"))))
        .withColumn("begin", begin)
        .withColumn("origin", F.greatest(F.lit(0), F.col("begin") - LEFT_HALO))
        .withColumn("until", F.least("n_bytes", F.col("begin") + range_bytes))
        # The right halo lets a piece that starts in this range end outside it.
        .withColumn("body", F.expr(f"substring(whole, int(origin + 1), int(until + {limit + 8} - origin))"))
        .drop("whole")
        # Repeated rows meet before the shuffle. What follows reads all columns
        # in both places, so both share the exchange.
        .dropDuplicates(["item", "version", "range_no"])
    )
    cuts = (
        ranges.filter("item IS NOT NULL AND version IS NOT NULL AND range_no IS NOT NULL").mapInPandas(_detecting(limit), CUTS)
        .repartition(parts, "item", "version").sortWithinPartitions("item", "version", "range_no")
    )
    plan = (
        cuts.mapInPandas(_planning(limit, overlap, range_bytes), PLAN)
        .groupBy("item", "version", "range_no").agg(F.collect_list(F.struct("piece_no", "start_byte", "end_byte", "overlap_bytes")).alias("plan"))
    )
    before = Window.partitionBy("item", "version").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = cuts.select("item", "version", "range_no", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"))
    planned = plan.join(lines, ["item", "version", "range_no"])
    return ranges.join(planned, ["item", "version", "range_no"]).mapInPandas(_emit, PIECES)


def split_report(pieces: DataFrame) -> DataFrame:
    """Number of pieces, bytes and repeated bytes of every item."""
    return pieces.groupBy("item", "version").agg(
        F.count("*").alias("n_pieces"), F.max("end_byte").alias("n_bytes"), F.sum("overlap_bytes").alias("repeated_bytes"))
