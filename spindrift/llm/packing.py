"""Filling fixed-capacity containers with texts, measured in tokens.

Only ids and lengths travel. Items are spread over blocks by a hash of their id,
and each block is packed by bin completion: take the largest item left, list the
undominated ways to fill the rest of its container, go on with the best of them
and come back to the others while the total waste can still beat the incumbent,
which is the best-fit-decreasing packing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.tables import arrow_batches, parts_for

CAPACITY = 2048
BLOCK_ITEMS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the tokenizer's vocabulary expects a text to be divided.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fillings looked at for one container, and kept as alternatives.
FILL_STEPS, ALTERNATIVES = 200, 3
#: Containers that may be opened again, as a multiple of those needed.
REVISITS = 2

LENGTHS = "doc_id long, text_hash long, n_tokens int"
PLACED = "container long, position int, doc_id long, token_start int, token_end int"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def fillings(room: int, have: list[int], present: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best undominated fillings of ``room`` as (waste, sizes), best first.

    ``have[s]`` items of size ``s`` are left; bit ``s`` of ``present`` is set if
    any. Sizes go down, larger first, so of fillings with equal sums the one
    with larger items is met first, which dominates those with smaller ones.
    A filling counts only if it wastes less than those before it.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, best = FILL_STEPS, room + 1
    used: dict[int, int] = {}
    chosen: list[int] = []

    def largest(limit: int) -> int:
        return (present & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def go(left: int, limit: int) -> None:
        nonlocal steps, best
        full = True
        s = largest(min(left, limit))
        while s >= 1 and best > 0 and steps > 0:
            steps -= 1
            n = used.get(s, 0)
            if n < have[s]:
                full = False
                used[s] = n + 1
                chosen.append(s)
                go(left - s, s)
                chosen.pop()
                used[s] = n
                if left == s:
                    return  # an exact single item dominates all other ways
            s = largest(s - 1)
        if full and left < best:
            best = left
            found.append((left, tuple(chosen)))

    go(room, room)
    return found[: -ALTERNATIVES - 1 : -1]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; the incumbent."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by room left
    present, out = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fit = present >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            c = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            c, room = len(out), capacity
            out.append([])
        out[c].append(i)
        room -= s
        rooms[room].append(c)
        present |= 1 << room
    return out


def bin_completion(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of item numbers; every size is 1 to ``capacity``."""
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = max(-(-total // capacity), sum(s > capacity // 2 for s in sizes))
    if len(incumbent) <= bound:
        return incumbent
    have = [0] * (capacity + 1)
    for s in sizes:
        have[s] += 1
    present = sum(1 << s for s in range(1, capacity + 1) if have[s])
    spare = (len(incumbent) - 1) * capacity - total  # waste of any better packing

    def take(size: int) -> None:
        nonlocal present
        have[size] -= 1
        if not have[size]:
            present &= ~(1 << size)

    def put(size: int) -> None:
        nonlocal present
        have[size] += 1
        present |= 1 << size

    # One entry a container: its largest item, other fillings, the one taken.
    stack: list[tuple[int, list, tuple[int, ...], int]] = []
    waste, revisits = 0, REVISITS * len(incumbent)
    while present:
        first = present.bit_length() - 1
        take(first)
        options = fillings(capacity - first, have, present)
        while not (options := [o for o in options if waste + o[0] <= spare]):
            put(first)
            if not stack or not revisits:
                return incumbent
            revisits -= 1
            first, options, fill, lost = stack.pop()
            waste -= lost
            for size in fill:
                put(size)
        (lost, fill), *options = options
        for size in fill:
            take(size)
        stack.append((first, options, fill, lost))
        waste += lost
    waiting: dict[int, list[int]] = {}
    for i in reversed(range(len(sizes))):
        waiting.setdefault(sizes[i], []).append(i)
    return [[waiting[size].pop() for size in (first, *fill)] for first, _, fill, _ in stack]


def _lengths(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for f in frames:
            n = [len(enc.encode_ordinary(t)) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "text_hash": f.text_hash, "n_tokens": np.array(n, np.int32)})

    return run


def pack_block(block: int, ids: list[int], lengths: list[int], capacity: int) -> list[tuple]:
    """Rows of :data:`PLACED` for the items of one block."""
    out, rest = [], []
    number = block << 32
    for i, (d, n) in enumerate(zip(ids, lengths)):
        whole = n // capacity if n > capacity else 0
        for part in range(whole):
            out.append((number, 0, d, part * capacity, (part + 1) * capacity))
            number += 1
        if n > whole * capacity:
            rest.append((d, whole * capacity, n))
    for items in bin_completion([e - s for _, s, e in rest], capacity) if rest else []:
        for position, i in enumerate(items):
            out.append((number, position, *rest[i]))
        number += 1
    return out


def _pack(capacity: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "text_hash"])
        rows = pack_block(int(f.block.iloc[0]), f.doc_id.tolist(), f.n_tokens.tolist(), capacity)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])

    return run


def token_lengths(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of all texts that are not null or empty."""
    arrow_batches(documents.sparkSession)
    return (
        documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(_lengths(path), LENGTHS)
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Containers of at most ``capacity`` tokens with as little room left as found.

    Result: container, position (from 0), doc_id, token_start, token_end (end
    exclusive). A text longer than ``capacity`` fills whole containers, and its
    rest is an item like others; no other text is divided. Null and empty texts
    and null ids are left out. Rows that repeat id and text count once; one id
    with different texts is packed once for each. ``path`` names the vocabulary.

    Blocks of about ``block_items`` items are packed apart, which costs at most
    one container that is not full for each. Within a block the search goes back
    a bounded number of times; it then keeps the incumbent.
    """
    blocks = parts_for(documents.count(), block_items)
    return (
        token_lengths(documents, path)
        .groupBy("doc_id", "text_hash").agg(F.min("n_tokens").alias("n_tokens"))  # so that a block is bounded
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
        .groupBy("block").applyInPandas(_pack(capacity), PLACED)
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room that stays unused."""
    room = F.countDistinct("container") * capacity
    used = F.sum(F.col("token_end") - F.col("token_start"))
    return placed.agg(F.countDistinct("container").alias("n_containers"), used.alias("n_tokens"), (1 - used / room).alias("unused_share"))
