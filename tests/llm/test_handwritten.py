import pytest
from pyspark.sql import functions as F

from spindrift.llm import handwritten as H

VERBS = "read write merge split parse build store fetch queue index render update verify select".split()
NOUNS = "buffer packet window stream ledger folder session timer marker symbol record policy region".split()


def python(seed, n=12):
    names = [f"{VERBS[(seed + i) % 14]}_{NOUNS[(seed * 3 + i) % 13]}" for i in range(n)]
    return "\n".join(f"def {a}({b}):\n    return {b}.{c}({i + seed})\n" for i, (a, b, c) in enumerate(zip(names, names[1:] + names[:1], names[2:] + names[:2])))


MINIFIED = "".join(f"function {a}({b},{c}){{return {d}.{b}({i}31)}}var {c}={a}?{b}:{d}[{c}+{i}7];" for i, (a, b, c, d) in enumerate(zip("abcdefghij", "qwertyuiop", "zxcvbnmlkj", "lkjhgfdsap")))
def script(seed):
    return python(seed).replace("def ", "export function ").replace("):\n", ") {\n").replace(")\n", ");\n}\n")


FILES = {
    "own_script": ("src/a.ts", script(1) + script(5), None), "own_script2": ("src/b.ts", script(2) + script(9) + script(4), None),
    "own": ("src/a.py", python(1), None), "own_header": ("src/b.py", "# Part of the Demo workspace (ab12); see LICENSE in the root.\n" + python(2), None), "vendor_invoice": ("src/vendor_invoice.py", python(3), None),
    "emits": ("tools/emit.py", '# writes the banner "Code generated by x 1. DO NOT EDIT." at the top\n' + python(4) + '\nprint("// Code generated by x")\n', None), "constants": ("src/c.py", "# please DO NOT EDIT the constants below without asking the team\n" + python(5), None),
    "small_data": ("src/d.py", python(6, 30) + "T = [1, 2, 3, 4, 5, 6, 7, 8, 9]\n", None), "dir": ("web\\node_modules\\lib\\x.js", python(7), "vendored"), "listed": ("src/e.py", python(8), "vendored"),
    "owner": ("src/f.py", "# Copyright 2021 the Other authors (ab). Redistributed under the Open terms.\n" + python(9), "vendored"), "banner": ("src/g.py", "# Code generated by protowright 3. DO NOT EDIT.\n" + python(10), "generated"),
    "german": ("src/h.py", "# Ein Text\n# Automatisch erzeugt aus x.xml (Lauf 3). Nicht bearbeiten!\n" + python(11), "generated"), "pb": ("api/x_pb2.py", python(12), "generated"), "min": ("src/x.js", MINIFIED, "minified"),
    "hex": ("src/t.rs", "pub static T: &[u32] = &[\n" + "  0x7d751711, 0xa3399940, 0xafb83819,\n" * 20 + "];", "data"), "csv": ("src/geo.c", "41.51,-16.92,22055\n" * 20, "data"), "base64": ("src/b64.py", "\n".join(f"D{i} = 'qzEVkTrGcFTu4UfBJbuj8GDU4FWYkp6tmvpHnoG6'" for i in range(9)), "data"),
    "cases": ("src/table.go", "// step_table\n" + "".join(f"    case {i * 7919}: return step({i}, {i * 31});\n" for i in range(40)), "generated"), "no_text": ("src/empty.py", None, None), "blank": ("src/blank.py", "", None),
}


@pytest.fixture(scope="module")
def judged(spark):
    files = spark.createDataFrame([("g", k, p, "sha:DD" if k == "listed" else None, None, "c", 1) for k, (p, _, _) in FILES.items()] * 2 + [("g", None, "x", "dd", None, "c", 1), ("g", "nopath", None, None, None, "c", 1)],
                                  "generation_id string, file_id string, path string, content_digest string, language string, reason string, names int")
    chunks = spark.createDataFrame([(f"c_{k}", k, t, "c") for k, (_, t, _) in FILES.items()] * 2 + [(None, None, "text", "c"), ("c9", "stranger", "text", "c")], "chunk_id string, file_id string, text string, language string")
    releases = spark.createDataFrame([("pkg", "dd"), ("pkg", None)], "package string, content_digest string")
    return files, chunks, releases


def test_reasons(judged, rows):
    assert dict(rows(H.judged_files(*judged), "file_id", "reason")) == {k: r for k, (_, _, r) in FILES.items()} | {"nopath": None}


def test_two_chunks_are_one_file(judged, rows, spark):
    files, chunks, releases = judged
    more = chunks.unionByName(spark.createDataFrame([("second", "min", python(1, 40), "c")], chunks.schema))
    assert dict(rows(H.judged_files(files, more, releases), "file_id", "reason"))["min"] is None


def test_empty(judged):
    files, chunks, releases = judged
    assert H.judged_files(files.limit(0), chunks, releases).count() == 0
    got = {r.file_id: r.reason for r in H.judged_files(files, chunks.limit(0), releases.limit(0)).collect()}
    assert got["dir"] == "vendored" and got["listed"] is None and got["hex"] is None


def test_quotes_and_late_comments_are_no_header():
    assert H.header("# a\n\n# b\nx = 1\n# c") == ["# a", "# b"] and H.header("# " + "x" * 300) == ["# " + "x" * 300]


def test_headers_of_any_length_and_form():
    banner = "Code generated by x 3. DO NOT EDIT."
    for text in ("# a licence\n" * 90 + f"# {banner}\nx = 1", f"/*\n a block\n {banner}\n*/\nint x;", f'\"\"\"Text.\n\n{banner}\n\"\"\"\nx = 1', f"package a.b;\n\n// {banner}\nclass A {{}}", f"<!--\n{banner}\n-->\n<a/>"):
        assert any(H.TOOL_HEADER.search(x) for x in H.header(text)), text
    assert H.header(f"x = 1\n/*\n{banner}\n*/") == [] and H.header('\"\"\"one line\"\"\"\nx = 1') == ["one line"]


def test_legs_decide_without_paths_and_headers(judged, rows, monkeypatch):
    """Mangled and template-like files are found by names alone, and only entropy finds the mangled one."""
    files, chunks, releases = judged
    bare = files.withColumn("path", F.lit(None).cast("string"))
    got = {r.file_id: (r.reason, r.evidence) for r in H.judged_files(bare, chunks, releases.limit(0)).collect()}
    assert got["min"] == ("minified", "entropy") and got["cases"] == ("generated", "diversity") and got["own"] == (None, "")
    monkeypatch.setattr(H, "MANGLED_EXCESS", 1e9)
    monkeypatch.setattr(H, "FOREIGN_EXCESS", 1e9)
    assert {r.file_id: r.reason for r in H.judged_files(bare, chunks, releases.limit(0)).collect()}["min"] is None


def test_foreign_style_decides_alone(judged, spark):
    files, chunks, releases = judged
    odd = "def xQz_wVk9(ZjX_qWw2):\n    kkQvZ_x7 = WxQ_zzJ4(vKq_XwZ1, qZZ_kXv3)\n    return write_packet(merge_window)\n"
    f = files.unionByName(spark.createDataFrame([("g", "odd", "src/odd.py", None, None, "c", 1)], files.schema))
    c = chunks.unionByName(spark.createDataFrame([("c_odd", "odd", odd, "c")], chunks.schema))
    got = {r.file_id: (r.reason, r.evidence) for r in H.judged_files(f, c, releases).collect()}
    assert got["odd"] == ("vendored", "style") and got["own"] == (None, "")


def test_code_behind_a_comment_is_judged(judged, rows, spark):
    files, chunks, releases = judged
    more = {
        "joined": (";(function(){" + MINIFIED + "})();", "minified"), "licence": ("/*! lib 1.2 | (c) Copyright the Lib authors, all rights */" + MINIFIED, "vendored"),
        "plain": ("/*! lib */" + MINIFIED, "minified"), "data": ("/* t */ [" + "7711,9940,8194,2201," * 40 + "]", "data"), "starred": ("/* a text\n * more */" + MINIFIED, "minified"),
    }
    f = files.unionByName(spark.createDataFrame([("g", k, f"src/{k}.js", None, None, "c", 1) for k in more], files.schema))
    c = chunks.unionByName(spark.createDataFrame([(f"c_{k}", k, t, "c") for k, (t, _) in more.items()], chunks.schema))
    got = dict(rows(H.judged_files(f, c, releases), "file_id", "reason"))
    assert {k: got[k] for k in more} == {k: r for k, (_, r) in more.items()}


def test_comments_and_the_code_behind_them():
    assert H.code_of("; a lisp remark\n* a line of a block\n/* open\n# remark (x)\n/* a */ /* b */ f(1)\n;(g)(2)") == "\n\n\n\n f(1)\n;(g)(2)"
    for remark in (" * if the queue (or the cache) is full", " * return the value", "* - item", "; if (a) then b", ";; (defun f)", ";-----", ";(defun f (x) x)", ";[section]", "*emphasis* in prose"):
        assert H.code_of(remark) == ""
    for code in (";!function(e,t){}(this)", ";((a,b)=>a+b)(1,2)", ";var a=1", ";[1,2].map(f)", "*count = 3", "*(p + 1) |= f"):
        assert H.code_of(code) == code
    assert H.header("/*! lib | licence */" + "f(1);" * 90) == ["/*! lib | licence */"] and H.header(";(f)(1)\n// late") == []
