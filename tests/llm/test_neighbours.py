import numpy as np
import pytest

from spindrift.llm import neighbours as N

ROW = "ordinal long, entity_id string, dimension int, embedding array<float>, unit string, dim int, rep string"


def brute(vectors, k, least):
    out = set()
    for a, x in vectors.items():
        scored = []
        for b, y in vectors.items():
            if a != b and len(x) == len(y):
                c = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                if c >= least:
                    scored.append((-round(c, 6), b))
        out |= {(a, b) for _, b in sorted(scored)[:k]}
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = {}
    for i in range(40):
        base = rng.normal(size=32)
        for j in range(5):
            vectors[f"e{i}_{j}"] = (base + rng.normal(size=32) * 0.12 * j).astype(np.float32) * rng.uniform(0.1, 9)
    for i in range(60):
        vectors[f"r{i}"] = rng.normal(size=24).astype(np.float32)
    copy = rng.normal(size=32).astype(np.float32)
    for i in range(25):
        vectors[f"copy{i:02}"] = copy * (1 + i % 3)
    vectors["near"] = copy + 0.05 * rng.normal(size=32).astype(np.float32)
    rows = [(i, k, len(v), [float(x) for x in v], "c", 1, "c") for i, (k, v) in enumerate(vectors.items())]
    bad = [(1, "null", 32, None, "c", 1, "c"), (1, "short", 32, [1.0], "c", 1, "c"), (1, "zero", 2, [0.0, 0.0], "c", 1, "c"), (1, "nan", 2, [float("nan"), 1.0], "c", 1, "c"), (1, "inf", 2, [float("inf"), 1.0], "c", 1, "c"),
           (1, "hole", 2, [None, 1.0], "c", 1, "c"), (1, None, 2, [1.0, 1.0], "c", 1, "c"), (1, "nodim", None, [1.0, 1.0], "c", 1, "c"), (1, "empty", 0, [], "c", 1, "c")]
    return vectors, spark.createDataFrame(rows * 2 + bad, ROW)


@pytest.mark.parametrize("block", [8192, 7])
def test_close_pairs_match_brute_force(data, block):
    vectors, df = data
    got = {(r.entity_id, r.neighbour) for r in N.nearest(df, k=10, least=0.9, block=block).collect()}
    assert got == brute(vectors, 10, 0.9)


def test_copies_are_ordered_by_id_and_bounded(data):
    _, df = data
    out = [r for r in N.nearest(df, k=10, least=0.9).collect() if r.entity_id == "copy24"]
    assert [r.neighbour for r in sorted(out, key=lambda r: r.rank)] == [f"copy{i:02}" for i in range(10)]


def test_recall_of_a_search(data):
    vectors, df = data
    exact = N.nearest(df, k=5, tables=1, probes=1 << 20, queries="ordinal % 5 = 0")
    assert {(r.entity_id, r.neighbour) for r in exact.collect()} == {p for p in brute(vectors, 5, -2) if list(vectors).index(p[0]) % 5 == 0}
    lost = N.lost_neighbours(N.nearest(df, k=5, tables=4, probes=24, queries="ordinal % 5 = 0"), exact).collect()
    assert sum(r.n_found for r in lost) >= 0.9 * sum(r.n_true for r in lost) and all(r.n_lost == r.n_true - r.n_found for r in lost)


def test_two_functions(data):
    vectors, df = data
    got = {(r.entity_id, r.neighbour) for r in N.nearest(df, k=10, least=0.9, functions=2, tables=8, probes=8).collect()}
    want = brute(vectors, 10, 0.9)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_pairs_and_empty(spark, data):
    _, df = data
    p = N.similar_pairs(N.nearest(df, least=0.9)).collect()
    assert all(r.entity_a < r.entity_b for r in p) and len(p) == len(set(p))
    assert N.nearest(spark.createDataFrame([], ROW), least=0.9).count() == 0
    assert N.nearest(df.filter("embedding IS NULL"), least=0.9).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48)).astype(np.float32)
    assert np.allclose(np.linalg.norm(N.rotated(x, 1), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_dense_cluster_is_answered_from_exact_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    vectors = {f"d{i:03}": (base + rng.normal(size=32) * 0.01).astype(np.float32) for i in range(N.MOST_OPEN * 2)}
    df = spark.createDataFrame([(i, e, 32, [float(x) for x in v]) for i, (e, v) in enumerate(vectors.items())], "ordinal long, entity_id string, dimension int, embedding array<float>")
    x = np.array(list(vectors.values()), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {e: i for i, e in enumerate(vectors)}
    kth = np.sort(x @ x.T - 3 * np.eye(len(x)), axis=1)[:, -3]
    for block in (8192, 50):
        got = [(at[r.entity_id], at[r.neighbour]) for r in N.nearest(df, k=3, least=0.9, block=block).collect()]
        # Single precision may exchange neighbours whose cosines differ by a millionth.
        assert len(set(got)) == 3 * len(vectors) and all(i != j and x[i] @ x[j] >= kth[i] - 2e-6 for i, j in got)


@pytest.mark.parametrize("bits", [4, 8])
def test_codes_bound_the_cosine(bits):
    x = np.random.default_rng(2).normal(size=(200, 47)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v, error = N.decoded(N.encoded(x, bits), 47, bits)
    assert np.allclose(np.linalg.norm(x - v, axis=1), error, atol=1e-6)
    want = x @ x.T
    for at, to, low, high in N.possible(v, error, v, error, 10, -2.0):
        assert (low <= want[at, to]).all() and (want[at, to] <= high).all()
        kept = set(zip(at, to))
        assert all((i, j) in kept for i in range(200) for j in np.argsort(-want[i])[:10])


def test_more_rows_take_more_functions():
    assert [N.functions_for(n, 64) for n in (0, 45_000, 10**7, 10**10)] == [1, 1, 2, 3]
    assert N.tables_for(64, 2, 4, 0.9, 0.998) > N.tables_for(64, 1, 2, 0.9, 0.998)
