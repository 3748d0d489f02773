import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import splitting as S

ROW = "chunk_id string, text string, start_line int, end_line int, item string, version long"


def planned(body: bytes, limit: int, overlap: int, width: int, thin: bool = True):
    p = S.Planner(len(body), limit, overlap)
    out = []
    for begin in range(0, len(body), width):
        until = min(len(body), begin + width)
        origin = max(0, begin - S.LEFT_HALO)
        found = S.boundaries(body[origin : until + limit + 8], origin, begin, until)
        out += p.feed(*(S.needed(*found, limit) if thin else found), until)
    return out


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab. ;}\n\té", min_size=1, max_size=900), st.sampled_from([64, 100]), st.integers(0, 16), st.sampled_from([100, 257, 4000]))
def test_plan_covers_and_does_not_depend_on_ranges(text, limit, overlap, width):
    b = text.encode()
    out = planned(b, limit, overlap, width)
    assert out == planned(b, limit, overlap, 1 << 20) == planned(b, limit, overlap, 1 << 20, thin=False)
    assert out[0][1] == 0 and out[-1][2] == len(b)
    for (_, _, end, _), (_, start, _, shared) in zip(out, out[1:]):
        assert start == end - shared and shared <= overlap + 3


def test_boundaries_sent_are_a_few_per_cent():
    code = "".join(f"def f{i}(a, b):\n    x = a.b(c, {i}); y = x + 1\n    return x.z if y else b\n\n" for i in range(9000)).encode()
    prose = ("Some words of a sentence, one after the other. " * 40 + "\n") .encode() * 300
    for text in (code, prose):
        offsets, classes = S.boundaries(text, 0, 0, len(text))
        kept = S.needed(offsets, classes, S.LIMIT)
        assert 5 * len(kept[0]) < 0.08 * len(text) and 5 * len(offsets) > 0.3 * len(text)


def check(pieces, texts, limit, overlap):
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["item"], p["version"]].append(p)
    for (item, _), ps in by.items():
        ps.sort(key=lambda p: p["piece_no"])
        b = next(t for t in texts[item] if len(t.encode()) == ps[-1]["end_byte"]).encode()
        for i, p in enumerate(ps):
            t = p["text"].encode()
            assert len(t) <= limit and b[p["start_byte"] : p["end_byte"]] == t and p["piece_no"] == i + 1
            assert p["start_line"] == 1 + b[: p["start_byte"]].count(b"\n") and p["end_line"] == 1 + b[: max(0, p["end_byte"] - 1)].count(b"\n")
            if i:
                assert p["start_byte"] == ps[i - 1]["end_byte"] - p["overlap_bytes"] and overlap <= p["overlap_bytes"] <= overlap + (3 if t.isascii() or b" " in b else 6)
    return by


def test_pieces(spark):
    prose = "One sentence of text. " * 900
    code = "int f() {\r\n  return 1;\r\n}\r\n\r\n" * 600
    solid = "日本" * 4000
    texts = {"prose": [prose], "code": [code], "solid": [solid], "two": [prose + "x", code + "yy"], "small": ["a" * 8192]}
    rows = [(k, t, n, None, "clash", 1) for k, ts in texts.items() for t in ts for n in ((1,) if k != "prose" else (None,))]
    rows += [(None, prose, 1, 1, "c", 1), ("null", None, 1, 1, "c", 1), ("empty", "", 1, 1, "c", 1)]
    df = spark.createDataFrame(rows * 2, ROW)
    for width in (8192, 1 << 20):
        by = check([r.asDict() for r in S.split_oversized(df, range_bytes=width).collect()], texts, 8192, 256)
        assert {k for k, _ in by} == {"prose", "code", "solid", "two"} and len([k for k in by if k[0] == "two"]) == 2
    ends = {k[0]: {p["text"][-1] for p in ps[:-1]} for k, ps in by.items() if k[0] != "two"}
    assert ends["prose"] == {"."} and ends["code"] == {"\n"}
    blank = [p["text"] for k, ps in by.items() if k[0] == "code" for p in ps[:-1]]
    assert all(t.endswith("\r\n\r\n") for t in blank)


def test_minified_ends_at_statements(spark):
    df = spark.createDataFrame([("m", "a(b);" * 5000, -3, None, "c", 1)], ROW)
    out = S.split_oversized(df).collect()
    assert all(r.text.endswith(";") for r in out) and {r.start_line for r in out} == {1}


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], ROW)
    assert S.split_oversized(df).count() == 0 and S.split_report(S.split_oversized(df)).count() == 0
    for kw in ({"overlap": 5000}, {"limit": 10}, {"range_bytes": 100}):
        with pytest.raises(ValueError):
            S.split_oversized(df, **kw)
