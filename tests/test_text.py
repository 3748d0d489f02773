import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import excerpts as E
from spindrift.functions import ids, text
from spindrift.sources.ingest import chunked


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(col).collect()[0][0]


def test_terms(spark):
    q = "  (parse_request) src/parser.rs, `Validates` HttpClient::send  "
    assert one(spark, text.query_terms(F.col("q")), q=q) == sorted({"parse_request", "src", "parser", "rs", "validates", "httpclient", "send"})
    assert one(spark, text.exact_terms(F.col("q")), q=q) == sorted({"parse_request", "src/parser.rs", "Validates", "HttpClient::send"})
    assert one(spark, text.identifier_terms(F.col("q")), q=q) == ["HttpClient::send", "parse_request"]
    assert one(spark, text.identifier_terms(F.col("q")), q="word") == ["word"]
    assert "a b" in one(spark, text.path_terms(F.col("q")), q=" a b ")
    assert one(spark, text.tokens(F.col("q")), q="ab " + "x" * 300) == ["ab"]


@pytest.mark.parametrize("q", [" ".join(f"t{i}" for i in range(257)), "x" * 16_385])
def test_query_bounds(spark, q):
    with pytest.raises(Exception, match="query"):
        one(spark, text.query_terms(F.col("q")), q=q)


def test_lines(spark):
    t = "a\r\nb\n\nc\n"
    assert one(spark, text.line_excerpt(F.col("t"), F.lit(1), F.lit(2)), t=t) == "a\nb"
    assert one(spark, text.exact_lines(F.col("t"), F.lit(4), F.lit(4)), t=t) == "c"
    assert one(spark, text.exact_lines(F.col("t"), F.lit(4), F.lit(5)), t=t) is None
    assert one(spark, text.resolved_excerpt(F.col("t"), F.lit(10), F.lit(11), F.lit(12)), t=t) == "b\n\n"
    assert one(spark, text.excerpt_end(F.lit(5), F.lit(6), F.col("t")), t=t) == 6


def test_revision_language_citation_slug(spark):
    assert one(spark, text.base_revision(F.col("r")), r="ab+dirty.cd") == "ab" and one(spark, text.dirty_digest(F.col("r")), r="ab+dirty.cd") == "cd" and one(spark, text.dirty_digest(F.col("r")), r="ab") is None
    assert one(spark, text.language_of_path(F.col("p")), p="a/B.TSX") == "tsx" and one(spark, text.language_of_path(F.col("p")), p="a/README") is None
    over = text.language_with_overrides(F.col("p"), [(r".*\.inc$", "C++"), (r"^gen/.*", "no such")])
    assert one(spark, over, p="a.inc") == "cpp" and one(spark, over, p="gen/a.py") is None
    c = one(spark, text.citations(F.col("b")), b="x `r@1:p/q.rs#sym:L1-L2` `code` `@:#:` `r@:p#s:`")
    assert [tuple(x) for x in c] == [("r", "p/q.rs", "sym"), ("r", "p", "s")]
    assert one(spark, text.slug(F.col("t")), t="A b_C--d ") == "a-b-c-d"
    with pytest.raises(Exception, match="file name"):
        one(spark, text.slug(F.col("t")), t="a/b")


def test_assertions(spark):
    for t, yes, no in (("it is enabled", True, False), ("does not support", False, True), ("supports it", True, False), ("must not", False, True), ("must", True, False), ("plain", False, False)):
        w = text.assertion_words(F.col("t"))
        assert (one(spark, text.states(w), t=t), one(spark, text.denies(w), t=t)) == (yes, no), t


def test_ids(spark):
    def framed(*parts):
        return hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)).hexdigest()

    assert one(spark, ids.file_id(F.col("a"), F.col("b")), a="répo", b="x" * 300) == "file_" + framed("file", "répo", "x" * 300)
    assert one(spark, ids.framed_id("k", F.lit("ab"), F.lit("c")), a="") != one(spark, ids.framed_id("k", F.lit("a"), F.lit("bc")), a="")
    assert one(spark, ids.repository_name(F.col("r")), r="git@Example.COM:team/thing.git") == one(spark, ids.repository_name(F.col("r")), r="https://user@example.com/team/thing.git/") == "git.11.example.com.4.team.5.thing"
    assert one(spark, ids.repository_name(F.col("r")), r="nothing") is None
    a, b = ids.new_ulid(1.0, b"\0" * 10), ids.new_ulid(2.0, b"\0" * 10)
    assert a < b and len(a) == 26
    for p, ok in (("a/b", True), ("/a", False), ("a/", False), ("a//b", False), ("a/../b", False), ("a\\b", False), ("", False)):
        assert one(spark, ids.valid_path(F.col("p")), p=p) is ok


@given(st.text(alphabet="ab é.\n;}{𝄞", max_size=80), st.integers(0, 60))
def test_truncation(t, n):
    out = E.truncated(t, n)
    assert (out == t) if len(t.encode()) <= n else (len(out.encode()) <= n and t.startswith(out))


def test_truncation_prefers_paragraphs():
    assert E.truncated("one\n\ntwo\nthree four", 14) == "one" and E.truncated("a;b cccc", 6) == "a;" and E.truncated("ééé", 3) == "é"


@settings(deadline=None)
@given(st.text(alphabet="ab \n", max_size=60), st.integers(4, 12))
def test_chunker(t, most):
    out = chunked(t, most)
    lines = t.split("\n")
    assert all(len(c.encode()) <= most for _, _, c in out) and [a for a, _, _ in out] == sorted(a for a, _, _ in out)
    assert "".join(c for _, _, c in out) == "".join(x for x in (y + "\n" for y in lines[:-1]) if x.strip()) + (lines[-1] if lines[-1].strip() else "")


def test_chunker_cases():
    assert chunked("") == [(1, 1, "")] and chunked("\n \n") == [(1, 1, "")]
    assert chunked("a\nb\n\nc") == [(1, 2, "a\nb\n"), (4, 4, "c")]
    assert chunked("aa\n" + "x" * 9 + "\nbb\n", 8) == [(1, 1, "aa\n"), (2, 2, "x" * 8), (2, 2, "x\n"), (3, 3, "bb\n")]


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_diff_applies(a, b):
    old, new = "\n".join(a), "\n".join(b)
    d = E.unified_diff(old, new, "f").splitlines()[3:]
    if old == new:
        assert not d
    else:
        assert "\n".join(x[1:] for x in d if x[0] in " -") == old and "\n".join(x[1:] for x in d if x[0] in " +") == new


def test_diff_removals_first():
    assert E.unified_diff("a", "b", "f").splitlines()[3:] == ["-a", "+b"]
    assert E.unified_diff(None, "b", "f").startswith("--- /dev/null\n+++ b/f\n@@ -1,0 +1,1 @@\n+b")


@given(st.binary(max_size=30), st.integers(0, 10), st.integers(0, 10), st.binary(max_size=4))
def test_patch_keeps_other_bytes(raw, a, n, new):
    if a + n <= len(raw):
        assert E.patched(raw, [(a, a + n, new)]) == raw[:a] + new + raw[a + n :]
    else:
        with pytest.raises(ValueError):
            E.patched(raw, [(a, a + n, new)])
