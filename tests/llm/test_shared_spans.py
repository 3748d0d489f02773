import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import rolling
from spindrift.llm import shared_spans as S

ROW = "chunk_id string, text string, record_id string, rid long, version long"


def brute(records, length):
    windows = {}
    for rid, text in records:
        for i in range(len(text) - length + 1):
            windows.setdefault(text[i : i + length], set()).add(rid)
    out = set()
    for rid, text in records:
        mark = [False] * len(text)
        for i in range(len(text) - length + 1):
            if len(windows[text[i : i + length]]) > 1:
                mark[i : i + length] = [True] * length
        start = None
        for i, m in enumerate([*mark, False]):
            if m and start is None:
                start = i
            elif not m and start is not None:
                out.add((rid, start, i))
                start = None
    return sorted(out)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcdefgh 日é\n") for _ in range(n))

    header, long, edge = noise(40), noise(300), noise(60)
    out = [(f"r{i}", header + noise(rng.randint(0, 200)) + (long[rng.randint(0, 100) : rng.randint(150, 300)] if i % 3 else "") + noise(30)) for i in range(40)]
    out += [("twin1", long), ("twin2", long), ("self", edge + "|" + edge), ("runs", "=" * 200), ("runs2", "x" + "=" * 90), ("e59", edge[:59]), ("e60", "q" + edge), ("short", "ab"), ("empty", "")]
    return out


def frame(spark, records):
    rows = [(*r, "c", 1, 2) for r in records] + [(None, "x" * 200, "c", 1, 2), ("null", None, "c", 1, 2)]
    return S.records_of((spark.createDataFrame(rows * 2, ROW), "chunk_id", "text"))


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_against_brute_force(spark, records, rows, hot):
    want = brute(records, 60)
    assert rows(S.shared_spans(frame(spark, records), length=60, gram=20, hot=hot)) == want
    assert ("self", 0, 60) in want and ("runs", 0, 200) in want and not any(w[0] == "e59" for w in want)


def test_plain_path_gives_the_same(spark, records, rows):
    df = frame(spark, records)
    assert rows(S.counted_spans(df, 60)) == rows(S.shared_spans(df, length=60, gram=20)) == rows(S.shared_spans(df, length=60, gram=20, hot=3))


def test_equal_hashes_of_different_windows_are_told_apart():
    import numpy as np

    class Same(rolling.Roller):
        def windows(self, codes):
            return np.ones_like(super().windows(codes))  # every window collides

    got = S.shared_windows(["abcdefgh", "xxcdefgx", "qqqqqqqq"], np.array([1, 2, 3]), 4, Same(4))
    assert [x.tolist() for x in got] == [x.tolist() for x in S.shared_windows(["abcdefgh", "xxcdefgx", "qqqqqqqq"], np.array([1, 2, 3]), 4, rolling.Roller(4))] == [[2, 2, -1], [3, 3, -1]]


def test_text_longer_than_a_slice(spark, rows):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh") for _ in range(300))
    filler = "".join(rng.choice("ijklmnop") for _ in range(S.SLICE))
    places = (10, S.SLICE - 150, S.SLICE + 5000)
    text = list(filler + filler[:9000][::-1])
    for p in places:
        text[p : p + 300] = part
    got = rows(S.shared_spans(frame(spark, [("long", "".join(text)), ("short", "q" * 7 + part)])))
    assert set(got) == {("long", p, p + 300) for p in places} | {("short", 7, 307)}


def test_report_and_empty(spark, records):
    df = frame(spark, records)
    got = {r.record_id: r for r in S.shared_report(df, S.shared_spans(df, length=60, gram=20)).collect()}
    assert got["twin1"].shared_chars == got["twin1"].n_chars == 300 and got["empty"].shared_chars == 0 and got["short"].n_spans == 0 and len(got) == len(records)
    assert S.shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(df, length=20, gram=20)


def test_one_id_with_two_texts(spark, rows):
    a, b = "".join(map(str, range(100))), "".join(map(str, range(300, 380)))
    got = rows(S.shared_spans(frame(spark, [("x", a), ("x", b + "tail"), ("y", a[:70]), ("z", b)]), length=60, gram=20))
    assert set(got) == {("x", 0, 70), ("x", 0, len(b)), ("y", 0, 70), ("z", 0, len(b))}


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=5))
def test_winnowing_keeps_an_anchor_in_every_stretch(texts):
    r = rolling.Roller(4)
    at, h = rolling.winnow(r, rolling.codes_of("".join(texts)), __import__("numpy").array([len(t) for t in texts]), 7)
    places = set(at.tolist())
    base = 0
    for t in texts:
        for i in range(len(t) - 9):
            assert any(base + i + j in places for j in range(7))
        base += len(t)
    hashes = r.windows(rolling.codes_of("".join(texts)))
    assert all(hashes[i] == v for i, v in zip(at, h))


def test_long_texts_are_sliced():
    parts = list(rolling.slices(["a" * 25, "b"], 10, 3))
    assert [(i, o, len(t)) for i, o, t in parts] == [(0, 0, 13), (0, 10, 13), (0, 20, 5), (1, 0, 1)]
