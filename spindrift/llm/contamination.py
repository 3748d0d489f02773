"""Evaluation texts leaking into training text.

Short test items are searched inside long documents by MinHash containment. The
items are partitioned by size; each keeps a bottom-k sketch of its word shingles
with a size that fits its partition, and documents are probed shingle by shingle
as they stream by, so a document needs no sketch and may be of any length. A
passage that meets enough of an item's sketch is a candidate. It must hold enough
of all the item's shingles (exact containment), and enough of its words in order.

The items are indexed once, on the driver, and broadcast; documents never move.
Items beyond what one index may hold are searched in several parts, each with an
index of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.normal import words
from spindrift.tables import arrow_batches

#: Words of a shingle. Five, the usual width, would lose passages in which one
#: word in ten is replaced.
SHINGLE = 3
#: Share of an item's words that a passage must hold, and of words replaced.
SHARE, REPLACED = 0.6, 0.1
#: Shingles that more items have are a pattern, not evidence of one item.
PATTERN_ITEMS = 2
#: Of the first size partition: most shingles, size of the sketch, hits needed.
FIRST_PARTITION = (45, 24, 4)
#: Items and words of one index.
INDEX_ITEMS, INDEX_WORDS = 50_000, 1_500_000

LEAKS = "doc_id long, item_id long, share double, shingle_share double, word_start int, word_end int"


def _rank(code: int) -> int:
    return int.from_bytes(hashlib.blake2b(code.to_bytes(16, "big"), digest_size=8).digest(), "big")


def partition_of(shingles: int) -> tuple[int, int]:
    """Size of the sketch and hits needed: each partition reaches half as far again, with 8 more hashes."""
    most, size, hits = FIRST_PARTITION
    while shingles > most:
        most, size, hits = most * 3 // 2, size + 8, hits + 1
    return size, hits


def least_containment(words: int, share: float = SHARE, replaced: float = REPLACED) -> float:
    """Share of an item's shingles that a passage keeps at least.

    Of ``share`` of the words, ``replaced`` of them others, each replaced word
    takes ``SHINGLE`` shingles with it.
    """
    kept = math.floor(share * words * (1 - SHINGLE * replaced)) - SHINGLE + 1
    return max(1, kept) / max(1, words - SHINGLE + 1)


class Items:
    """Vocabulary, sketches and shingles of the test items."""

    def __init__(self, items: list[tuple[int, str]]):
        texts: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in items:
            if item_id is not None and text:
                w = tuple(words(text))
                if w:
                    texts.setdefault(w, []).append(item_id)
        self.ids = [sorted(set(v)) for v in texts.values()]  # copies share one entry
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for w in texts]
        self.base = len(self.vocabulary) + 1
        if self.base**SHINGLE >= 1 << 62:
            raise ValueError("the items' vocabulary is too large for this operator")
        self.shingles = [np.unique(self.codes(w)) for w in self.words]
        everywhere = np.unique(np.concatenate([*self.shingles, np.zeros(0, np.int64)]), return_counts=True)
        sketch, owner, self.least = [], [], []
        for i, own in enumerate(self.shingles):
            size, need = partition_of(len(own))
            count = everywhere[1][np.searchsorted(everywhere[0], own)]
            # Min-wise order, pattern shingles last.
            order = sorted(range(len(own)), key=lambda j: (count[j] > PATTERN_ITEMS, count[j] if count[j] > PATTERN_ITEMS else 0, _rank(int(own[j]))))
            kept = own[order[:size]]
            sketch.append(kept)
            owner.append(np.full(len(kept), i))
            self.least.append(max(1, min(need, round(0.15 * len(kept)))))
        code, self.owner = np.concatenate([*sketch, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.sketch, self.owner = code[order], self.owner[order]
        self.least = np.array(self.least, np.int64)
        self.containment = [least_containment(len(w)) for w in self.words]
        self.size = np.array([len(w) for w in self.words], np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Shingle numbers; 0 where a word is not of the items."""
        n = len(ids) - SHINGLE + 1
        if n < 1:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SHINGLE):
            code = code * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, code, 0)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to) of passages that meet enough of an item's sketch."""
        code = self.codes(ids)
        at = np.flatnonzero(code)
        if not len(at) or not len(self.sketch):
            return []
        low = np.searchsorted(self.sketch, code[at])
        hit = self.sketch[np.minimum(low, len(self.sketch) - 1)] == code[at]
        at, low = at[hit], low[hit]
        if not len(at):
            return []
        n = np.searchsorted(self.sketch, code[at], "right") - low
        place = np.repeat(at, n)
        item = self.owner[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        width = len(ids) + int(self.size.max()) * 2 + 2
        key = np.sort(item * width + place)
        item, place = key // width, key % width
        # Hits of the same item within a passage of its length and a quarter.
        reach = np.searchsorted(key, key + (self.size[item] * 5) // 4 + 1)
        count = reach - np.arange(len(key))
        out = []
        for i in np.unique(item[count >= self.least[item]]):
            mine = np.flatnonzero((item == i) & (count >= self.least[i]))
            a, end = None, -1
            for m in mine:  # passages that overlap are one
                first, last = place[m], place[reach[m] - 1]
                if a is not None and first > end:
                    out.append((int(i), int(a), int(end)))
                    a = None
                a = first if a is None else a
                end = max(end, last)
            out.append((int(i), int(a), int(end)))
        return out

    def verify(self, ids: np.ndarray, item: int, first: int, last: int) -> tuple[float, float, int, int]:
        """Share of words in order, share of shingles, and the place of the passage."""
        own, n = self.words[item], int(self.size[item])
        a, b = max(0, first - n), min(len(ids), last + SHINGLE + n)
        part = ids[a:b]
        matched, start, end, stop = align(own, part)
        # Where in the item the passage begins: the same alignment read backwards.
        begin = stop - align(own[:stop][::-1], part[start:end][::-1])[3]
        more, end = extended(own[stop:], part[end:], math.ceil(n * REPLACED), end)
        less, back = extended(own[:begin][::-1], part[:start][::-1], math.ceil(n * REPLACED), 0)
        matched, start = matched + more + less, start - back
        inside = np.intersect1d(self.shingles[item], self.codes(part[start:end]))
        return matched / n, len(inside) / max(1, len(self.shingles[item])), a + start, a + end


def extended(item: np.ndarray, text: np.ndarray, replaced: int, end: int) -> tuple[int, int]:
    """Words in place behind replaced ones that continue a passage, and its new end.

    A lone word beyond a replaced one costs an alignment more than it earns, so
    the alignment ends before it. Each step takes replaced words, of ``replaced``
    in all, and the words in place that follow them.
    """
    n = min(len(item), len(text))
    same = item[:n] == text[:n]
    gained = at = 0
    while at < n:
        run = int(same[at:].argmax())  # replaced words before the next in place
        if not same[at + run] or run > replaced:
            break
        replaced -= run
        first = at = at + run
        while at < n and same[at]:
            at += 1
        gained += at - first
    return gained, end + at


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Most words of ``item`` that stand in order in one passage of ``text``.

    A local alignment: a word in place earns 1, a replaced or left-out word of
    the item costs 2, an inserted word 1. A passage in which one word in ten is
    replaced gains at every step; one that has only the pattern of a sentence in
    common, with other words filled in, loses. Returns words matched, start and end
    in the text, end in the item.
    """
    m = len(text)
    if not m or not len(item):
        return 0, 0, 0, 0
    # Score, words matched and start are packed into one number for the maxima.
    scale = np.int64(1) << 40
    start = np.arange(m + 1, dtype=np.int64)
    zero = (np.int64(1) << 20) - start  # prefers the nearest start at score 0
    row = np.concatenate([zero, [0]])[: m + 1].copy()
    matched_unit = np.int64(1) << 21
    best, best_end, best_stop = np.int64(-1), 0, 0
    step = np.arange(m + 1, dtype=np.int64) * scale
    for i, w in enumerate(item, 1):
        same = text == w
        moved = row[:-1] + np.where(same, scale + matched_unit, -2 * scale)
        new = np.maximum(row - 2 * scale, zero)
        new[1:] = np.maximum(new[1:], moved)
        new = np.maximum.accumulate(new + step) - step  # inserted words
        row = np.maximum(new, zero)
        top = int(row.argmax())
        if row[top] > best:
            best, best_end, best_stop = row[top], top, i
    rest = int(best) % int(scale)
    return rest >> 21, (1 << 20) - (rest & ((1 << 21) - 1)), best_end, best_stop


def _search(index, share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = index.value
        known = items.vocabulary.get
        for f in frames:
            out = []
            for doc_id, text in zip(f.doc_id.tolist(), f.text.tolist()):
                w = words(text)
                ids = np.fromiter((known(x, 0) for x in w), np.int64, len(w))
                best: dict[int, tuple] = {}
                for item, a, b in items.candidates(ids):
                    found = items.verify(ids, item, a, b)
                    if found[0] >= share and found[1] >= items.containment[item] and found > best.get(item, (0.0,)):
                        best[item] = found
                out += [(doc_id, i, *found) for item, found in best.items() for i in items.ids[item]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEAKS.split(", ")]).astype({"doc_id": "int64", "item_id": "int64"})

    return run


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE * (1 - REPLACED),
                 index_items: int = INDEX_ITEMS, index_words: int = INDEX_WORDS) -> DataFrame:
    """Documents that hold a passage of a test item.

    Result: doc_id, item_id, share (of the item's words found in order in one
    passage), shingle_share, word_start, word_end; one row per document row and
    item, for the best passage. ``share`` is the least share of words in order:
    60 % of the item, of which one word in ten may be replaced; the least share
    of shingles is what such a passage keeps (:func:`least_containment`).

    Case, punctuation, white space, markup, entities, accents and look-alike
    letters do not matter. Null and empty texts and null ids hold nothing and
    leak nowhere; copies of an item leak together. Repeated rows give repeated
    results. Items beyond ``index_items`` or ``index_words`` are searched in
    parts, divided by a hash of their text, each in a pass of its own over the
    documents; what many items share is then told within a part.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    asked = items.select("item_id", "text").filter("item_id IS NOT NULL AND text <> ''").distinct()
    n, n_words = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    parts = max(1, math.ceil(n / index_items * 1.2) if n > index_items else 1, math.ceil(n_words / index_words * 1.2) if n_words > index_words else 1)
    rows = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for part in range(parts):
        own = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        index = spark.sparkContext.broadcast(Items(sorted((r.item_id, r.text) for r in own.collect())))
        leaks = rows.mapInPandas(_search(index, share), LEAKS)
        found = leaks if found is None else found.unionByName(leaks)
    return found
