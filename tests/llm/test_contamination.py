import random

import pytest

from spindrift.llm import contamination as C
from spindrift.llm.normal import words

rng = random.Random(2)
VOCAB = [f"w{i}x" for i in range(400)]
ITEMS = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(40, 90))).capitalize() + ".") for i in range(40)]


def noise(n):
    return " ".join(f"n{rng.randrange(900)}" for _ in range(n))


def altered(text, rate):
    w = text.split()
    for i in range(len(w)):
        if i % round(1 / rate) == 3:
            w[i] = "changed"
    return " ".join(w)


def part(text, share, at=0.0):
    w = text.split()
    n = round(len(w) * share)
    a = int((len(w) - n) * at)
    return " ".join(w[a : a + n])


CASES = [
    ("whole", ITEMS[0][1], [0]), ("upper", ITEMS[1][1].upper(), [1]), ("part", part(ITEMS[2][1], 0.65, 0.5), [2]), ("replaced", altered(ITEMS[3][1], 0.1), [3]), ("part replaced", altered(part(ITEMS[4][1], 0.7), 0.1), [4]),
    ("markup", ITEMS[5][1].replace(" ", " <b>", 3).replace("x ", "x</b>&#44; ", 3), [5]), ("lines", "\n// ".join(ITEMS[6][1].split()), [6]), ("look-alike", ITEMS[7][1].replace("x", "х"), [7]), ("zero width", ITEMS[8][1].replace("w", "w​"), [8]),
    ("two", ITEMS[9][1] + " " + noise(20) + " " + ITEMS[10][1], [9, 10]), ("quote", part(ITEMS[11][1], 0.3), []), ("shuffled", " ".join(rng.sample(ITEMS[12][1].split(), len(ITEMS[12][1].split()))), []),
    ("halves apart", part(ITEMS[13][1], 0.45) + " " + noise(400) + " " + part(ITEMS[13][1], 0.45, 1.0), []), ("pattern", " ".join(x if i % 3 else "slot" for i, x in enumerate(ITEMS[14][1].split())), []), ("nothing", "", []),
]


@pytest.mark.parametrize("pad", [0, 50, 3000])
def test_cases(spark, pad):
    docs = [(i, f"{noise(pad)} {t} {noise(pad)}", "c", 1) for i, (_, t, _) in enumerate(CASES)] + [(None, ITEMS[0][1], "c", 1), (99, None, "c", 1), (98, "", "c", 1)]
    df = spark.createDataFrame(docs * 2, "doc_id long, text string, item_id string, share int")
    items = spark.createDataFrame([(*x, 1) for x in ITEMS] * 2 + [(None, ITEMS[1][1], 1), (500, None, 1), (501, "", 1), (502, ITEMS[0][1].upper(), 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in C.leaked_items(df, items).collect()}
    want = {(i, x) for i, (_, _, xs) in enumerate(CASES) for x in xs} | {(0, 502)}
    assert got == want, {CASES[d][0] for d, _ in got ^ want}


@pytest.mark.parametrize("size", [{"index_items": 7}, {"index_words": 500}])
def test_parts_find_the_same(spark, size):
    df = spark.createDataFrame([(i, f"{noise(30)} {t} {noise(30)}") for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole, parts = ({tuple(r) for r in C.leaked_items(df, items, **k).collect()} for k in ({}, size))
    assert whole == parts and len(whole) > 8


@pytest.mark.parametrize("n", [40, 57, 90])
def test_edges_of_a_passage_count_behind_replaced_words(n):
    """Sixty per cent of an item with one word in ten replaced, wherever these stand."""
    r = random.Random(n)
    item = [f"w{i}x" for i in range(n)]
    index = C.Items([(1, " ".join(item))])
    for _ in range(300):
        size = -(-n * 6 // 10)
        a = r.randrange(n - size + 1)
        part = item[a : a + size]
        for i in r.sample(range(size), size // 10):
            part[i] = "other"
        w = ["n"] * 20 + part + ["n"] * 20
        ids = index.vocabulary
        ids = C.np.array([ids.get(x, 0) for x in w])
        best = max((index.verify(ids, *c) for c in index.candidates(ids)), default=(0, 0))
        ends = part[0] == "other" or part[-1] == "other"
        assert ends or (best[0] >= 0.54 and best[1] >= index.containment[0]), (part, best)


def test_partitions_grow():
    assert [C.partition_of(n) for n in (1, 45, 46, 67, 68, 10**6)][:5] == [(24, 4), (24, 4), (32, 5), (32, 5), (40, 6)]
    assert C.partition_of(10**6)[0] < 300


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.leaked_items(df, none).count() == 0 and C.leaked_items(df.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def brute_align(item, text):
    best = (0, 0)
    n, m = len(item), len(text)
    h = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = item[i - 1] == text[j - 1]
            d, u, left = h[i - 1][j - 1], h[i - 1][j], h[i][j - 1]
            h[i][j] = max((0, 0), (d[0] + (1 if same else -2), d[1] + same), (u[0] - 2, u[1]), (left[0] - 1, left[1]))
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(1, 14))]
        n, start, end, _ = C.align(np.array(a), np.array(b))
        assert n == brute_align(a, b)[1] and 0 <= start <= end <= len(b)


def test_words():
    assert words("<b>Thé</b>&nbsp;ﬁle, рath_x ​One-two") == ["the", "file", "path", "x", "one", "two"]
