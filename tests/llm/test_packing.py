import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import packing as P


def fits(sizes, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)


def fewest(sizes, capacity):
    best = {0: (1, 0)}
    for m in range(1, 1 << len(sizes)):
        options = []
        for i, s in enumerate(sizes):
            if m >> i & 1:
                n, used = best[m ^ (1 << i)]
                options.append((n, used + s) if used + s <= capacity else (n + 1, s))
        best[m] = min(options)
    return best[(1 << len(sizes)) - 1][0]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_packings_are_best(sizes):
    bins = P.bin_completion(sizes, 20)
    fits(sizes, bins, 20)
    assert len(bins) == fewest(sizes, 20)


@settings(deadline=None, max_examples=25)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300))
def test_never_worse_than_best_fit(sizes):
    bins = P.bin_completion(sizes, 100)
    fits(sizes, bins, 100)
    assert len(bins) <= len(P.best_fit(sizes, 100))


def test_beats_best_fit_decreasing():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best fit needs three of capacity 60 more than the room asks
    bins = P.bin_completion(sizes, 60)
    fits(sizes, bins, 60)
    assert len(bins) == 3 < len(P.best_fit([27, 26, 23, 21, 19, 4, 30, 30], 60)) + 1


def test_blocks_divide_only_long_texts():
    rows = P.pack_block(3, [1, 2, 3], [5000, 10, 2048], 2048)
    mine = sorted(r[3:] for r in rows if r[2] == 1)
    assert mine == [(0, 2048), (2048, 4096), (4096, 5000)] and [r[3:] for r in rows if r[2] == 3] == [(0, 2048)]
    assert all(r[0] >> 32 == 3 for r in rows) and len({r[0] for r in rows}) == 4


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no vocabulary")
def test_documents(spark):
    texts = ["word " * n for n in (1, 500, 3000, 700)] + ["", None, "<|endoftext|>", "日本語 " * 50]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] * 2 + [(None, "x", "c", 1), (0, "other text", "c", 1)], "doc_id long, text string, block string, n_tokens int")
    for items in (20_000, 2):
        out = P.pack_documents(df, block_items=items).collect()
        enc = P.tokenizer(P.TOKENIZER)
        room, seen = {}, {}
        for r in out:
            room[r.container] = room.get(r.container, 0) + r.token_end - r.token_start
            seen.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        assert max(room.values()) <= P.CAPACITY and set(seen) == {0, 1, 2, 3, 6, 7}
        for d, parts in seen.items():
            n = sum(b - a for a, b in parts)
            assert n == len(enc.encode_ordinary(texts[d])) + (2 if d == 0 else 0)
        assert len(seen[2]) == 2 and len(seen[1]) == 1
    r = P.fill_report(P.pack_documents(df)).collect()[0]
    assert r.n_containers == len(room) or r.n_tokens == sum(room.values())
    assert P.pack_documents(df.limit(0)).count() == 0
