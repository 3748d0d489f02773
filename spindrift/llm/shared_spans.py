"""Long exact spans shared between records.

A span of at least ``length`` characters is shared if it also stands, character
for character, in a record with another id. The operator finds all of them:

0. Equal texts are one class. A class of several ids is shared as a whole, and
   takes part below as one text, however many copies it has.
1. Rabin-Karp hashes of every window of ``gram`` characters are winnowed so that
   each stretch of ``length`` characters keeps at least one anchor. Spark counts
   in how many texts an anchor occurs.
2. Only where an anchor repeats, the windows of ``length`` characters around it
   are hashed and compared between the texts that have the anchor. Windows with
   equal hashes are then compared character by character; those of an anchor
   that occurs very often stream by and are told apart by a cryptographic hash
   of 128 bits instead.
3. Repeated windows merge into maximal stretches.

Step 1 drops nothing: a shared window of ``length`` characters contains the same
anchors in both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.rolling import Roller, codes_of, slices, winnow
from spindrift.tables import arrow_batches, shuffle_parts

LENGTH = 120
GRAM = 48
#: Anchors with more occurrences are resolved window by window, in a stream.
HOT = 20_000
SLICE = 1 << 20
#: Windows whose characters are compared at a time.
COMPARED = 1 << 14

ANCHORS = "fp long, h1 long, h2 long, pos int"
NEAR = "g long, g2 long, rid long, h1 long, h2 long, start int, context string"
SPANS = "h1 long, h2 long, span_start int, span_end int"


def _anchors(length: int, gram: int):
    width = length - gram + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = Roller(gram, SLICE)

        def flush(h1: np.ndarray, h2: np.ndarray, part: list[tuple[int, int, str]]) -> pd.DataFrame:
            codes = codes_of("".join(p[2] for p in part))
            lengths = np.array([len(p[2]) for p in part])
            at, h = winnow(roller, codes, lengths, width)
            which = np.searchsorted(np.cumsum(lengths), at, "right")
            first = np.cumsum(lengths) - lengths
            row = np.array([p[0] for p in part], np.int64)[which]
            pos = at - first[which] + np.array([p[1] for p in part])[which]
            return pd.DataFrame({"fp": h.view(np.int64), "h1": h1[row], "h2": h2[row], "pos": pos.astype(np.int32)})

        for f in frames:
            keys, part, size = (f.h1.to_numpy(), f.h2.to_numpy()), [], 0
            for i, offset, text in slices(f.text.tolist(), SLICE, length - 1):
                part.append((i, offset, text))
                size += len(text)
                if size >= SLICE:
                    yield flush(*keys, part)
                    part, size = [], 0
            if part:
                yield flush(*keys, part)

    return run


def _surroundings(length: int, gram: int):
    """For each repeated anchor the text around it, as far as windows reach."""
    reach = length - gram

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: dict[str, list] = {c.split()[0]: [] for c in NEAR.split(", ")}

            def add(g, g2, r, start, context):
                for c, v in zip(out, (g, g2, r.rid, r.h1, r.h2, start, context)):
                    out[c].append(v)

            for r in f.itertuples():
                for fp, pos, hot in zip(r.fps, r.places, r.hots):
                    start = max(0, pos - reach)
                    context = r.body[start - r.origin : pos + length - r.origin]
                    if len(context) < length:
                        continue
                    if not hot:
                        add(fp, 0, r, start, context)
                    else:
                        raw = codes_of(context).tobytes()
                        for j in range(len(context) - length + 1):
                            digest = hashlib.blake2b(raw[4 * j : 4 * (j + length)], digest_size=16).digest()
                            add(int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), r, start + j, "")
            yield pd.DataFrame(out)

    return run


def same_characters(windows: np.ndarray, row: np.ndarray, col: np.ndarray, fresh: np.ndarray) -> bool:
    """Whether each window that does not begin a group equals the one before it, character for character."""
    next_ = np.flatnonzero(~fresh)
    for i in range(0, len(next_), COMPARED):
        a = next_[i : i + COMPARED]
        if not np.array_equal(windows[row[a], col[a]], windows[row[a - 1], col[a - 1]]):
            return False
    return True


def shared_windows(contexts: list[str], rids: np.ndarray, length: int, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """First and last shared window of each context, -1 where there is none."""
    most = max(map(len, contexts))
    codes = codes_of("".join(c.ljust(most, "\0") for c in contexts)).reshape(len(contexts), most)
    h = roller.windows(codes)
    n = h.shape[1]
    valid = np.arange(n)[None, :] + length <= np.array([len(c) for c in contexts])[:, None]
    flat = h[valid]
    rid = np.broadcast_to(rids[:, None], h.shape)[valid]
    order = np.argsort(flat, kind="stable")
    fresh = np.r_[True, np.diff(flat[order]) != 0]
    windows = np.lib.stride_tricks.sliding_window_view(codes, length, axis=1)
    row, col = (x[order] for x in np.nonzero(valid))
    if not same_characters(windows, row, col, fresh):
        # Different windows with one hash: number them by their characters.
        text = [windows[i, j].tobytes() for i, j in zip(row, col)]
        number = {t: i for i, t in enumerate(dict.fromkeys(text))}
        again = np.argsort(np.array([number[t] for t in text]), kind="stable")
        order, row, col = order[again], row[again], col[again]
        at = np.array([number[text[i]] for i in again])
        fresh = np.r_[True, np.diff(at) != 0]
    first = np.flatnonzero(fresh)
    several = np.minimum.reduceat(rid[order], first) != np.maximum.reduceat(rid[order], first)
    shared = np.zeros(len(flat), bool)
    shared[order] = np.repeat(several, np.diff(np.r_[first, len(flat)]))
    table = np.zeros(h.shape, bool)
    table[valid] = shared
    some = table.any(1)
    return np.where(some, table.argmax(1), -1), np.where(some, n - 1 - table[:, ::-1].argmax(1), -1)


def _resolve(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = Roller(length)
        columns = [c.split()[0] for c in SPANS.split(", ")]

        def near(f: pd.DataFrame) -> pd.DataFrame:
            f = f[f.context != ""]
            if not len(f):
                return pd.DataFrame({c: [0] for c in columns})[:0]
            a, b = shared_windows(f.context.tolist(), f.rid.to_numpy(), length, roller)
            start = f.start.to_numpy()
            keep = a >= 0
            return pd.DataFrame({"h1": f.h1[keep], "h2": f.h2[keep], "span_start": (start + a)[keep], "span_end": (start + b + length)[keep]})

        def of_windows(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"h1": f.h1, "h2": f.h2, "span_start": f.start, "span_end": f.start + length})

        # Windows of hot anchors stream by: as soon as a second record shows up
        # in a group, all its rows are known to be shared.
        held, group, owner, open_ = [], None, None, False
        rest = None
        for f in frames:
            hot = f[f.context == ""]
            if len(hot):
                done = []
                for g, part in hot.groupby(["g", "g2"], sort=False):
                    if g != group:
                        held, group, owner, open_ = [], g, part.rid.iloc[0], False
                    open_ = open_ or bool((part.rid != owner).any())
                    held.append(part)
                    if open_:
                        done += held
                        held = []
                if done:
                    yield of_windows(pd.concat(done))
            f = f[f.context != ""]
            if len(f):
                f = f if rest is None else pd.concat([rest, f])
                last = f.g.iloc[-1]
                rest = f[f.g == last]
                yield near(f[f.g != last])
        if rest is not None:
            yield near(rest)

    return run


def records_of(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """(record_id, text) of all sources, without nulls."""
    out = None
    for df, key, text in sources:
        part = df.select(F.col(key).alias("record_id"), F.col(text).alias("text")).filter("record_id IS NOT NULL AND text IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def shared_spans(records: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Maximal stretches of characters that also stand in another record.

    Takes (record_id, text). Result: record_id, span_start, span_end; offsets
    count code points from 0, the end is exclusive; one row per stretch.

    * A character is shared if it lies in a run of at least ``length``
      characters that occurs in a record with a different id. Repetition within
      a record, or in repeated rows of it, does not count.
    * Stretches that touch or overlap are one stretch.
    * One id with different texts: each text's stretches are reported, merged
      only within their text, so a row may appear for a part of another.
    * Null ids, null texts and texts shorter than ``length`` give nothing.
    """
    if not 8 <= gram < length:
        raise ValueError("needs 8 <= gram < length")
    spark = records.sparkSession
    arrow_batches(spark, 1000)
    parts = shuffle_parts(spark)
    texts = records.select("record_id", "text").filter(F.length("text") >= length).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    # Copies leave each task as one row. A class of several ids gets a number of
    # its own in place of an id, so it differs from every other.
    classes = (
        texts.groupBy("h1", "h2").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"), F.first("text").alias("text"))
        .select("h1", "h2", "text", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(F.xxhash64("h2", "h1")).alias("rid"), (F.col("lo") != F.col("hi")).alias("copied"))
    )
    # One exchange serves both the count and the way back to the places; the
    # filter is what the join below would otherwise add to one of the two only.
    anchors = classes.mapInPandas(_anchors(length, gram), ANCHORS).filter("fp IS NOT NULL AND h1 IS NOT NULL AND h2 IS NOT NULL").repartition(parts, "fp")
    repeated = (
        anchors.groupBy("fp")
        .agg(F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2"), F.count("*").alias("n"), F.max("pos").alias("far"))
        .filter("(a1 <> b1 OR a2 <> b2) AND far >= 0")
        .select("fp", (F.col("n") > hot).alias("hot"))
    )
    # A row of places and of text reaches over one slice, however long its text.
    places = (
        anchors.join(repeated, "fp").withColumn("slice", F.expr(f"pos div {SLICE}")).repartition(parts, "h1", "h2")
        .groupBy("h1", "h2", "slice").agg(F.collect_list(F.struct("fp", "pos", "hot")).alias("a"))
        .select("h1", "h2", "slice", F.col("a.fp").alias("fps"), F.col("a.pos").alias("places"), F.col("a.hot").alias("hots"))
    )
    origin = F.greatest(F.lit(0).cast("long"), F.col("slice") * SLICE - length)
    sliced = classes.join(places, ["h1", "h2"]).withColumn("origin", origin).select(
        "rid", "h1", "h2", F.when(F.length("text") > SLICE, F.expr(f"substring(text, int(origin + 1), {SLICE + 2 * length})")).otherwise(F.col("text")).alias("body"),
        F.when(F.length("text") > SLICE, F.col("origin")).otherwise(0).alias("origin"), "fps", "places", "hots")
    near = sliced.mapInPandas(_surroundings(length, gram), NEAR)
    pieces = near.repartition(parts, "g").sortWithinPartitions("g", "g2").mapInPandas(_resolve(length), SPANS)
    whole = classes.filter("copied").select("h1", "h2", F.lit(0).alias("span_start"), F.length("text").alias("span_end"))
    owners = texts.select("record_id", "h1", "h2").distinct()
    return merge_spans(pieces.unionByName(whole)).join(owners, ["h1", "h2"]).select("record_id", "span_start", "span_end").distinct()


def counted_spans(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """What :func:`shared_spans` gives, by the plain path: the hash of every window, counted.

    Moves 40 bytes for every character, so it serves to check results on tables
    that allow this.
    """
    texts = records.select("record_id", "text").filter(F.length("text") >= length).distinct().withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = Roller(length)
        for f in frames:
            for r in f.itertuples():
                h = roller.windows(codes_of(r.text)).view(np.int64)
                yield pd.DataFrame({"g": h, "record_id": r.record_id, "h1": r.h1, "h2": r.h2, "span_start": np.arange(len(h), dtype=np.int32)})

    windows = texts.mapInPandas(run, "g long, record_id string, h1 long, h2 long, span_start int")
    repeated = windows.groupBy("g").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).filter("lo <> hi").select("g")
    pieces = windows.join(repeated, "g").select("h1", "h2", "span_start", (F.col("span_start") + length).alias("span_end"))
    return merge_spans(pieces).join(texts.select("record_id", "h1", "h2"), ["h1", "h2"]).select("record_id", "span_start", "span_end").distinct()


def merge_spans(pieces: DataFrame) -> DataFrame:
    """Maximal stretches of each text from pieces that may overlap or touch."""
    w = Window.partitionBy("h1", "h2").orderBy("span_start", "span_end")
    return (
        pieces.distinct()
        .withColumn("reach", F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("n", F.sum(F.when(F.col("span_start") <= F.col("reach"), 0).otherwise(1)).over(w))
        .groupBy("h1", "h2", "n")
        .agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        .drop("n")
    )


def shared_report(records: DataFrame, spans: DataFrame) -> DataFrame:
    """For every record its length and how many of its characters are shared.

    One row per record_id; of different texts with one id the longest counts.
    """
    size = records.groupBy("record_id").agg(F.max(F.length("text")).alias("n_chars"))
    got = spans.groupBy("record_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    return size.join(got, "record_id", "left").fillna(0, ["n_spans", "shared_chars"])
