import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift import engine
from spindrift.operators import claims, validation
from spindrift.sources import checkout, ingest, notes, scip, store
from spindrift.streaming import watch

NOTE = """---
spindrift_schema: 1
spindrift_id: note_authentication
title: Authentication
custom_field: keep-me
spindrift_claims:
  ledger-order:
    status: current
    review: agent_generated
    anchors:
      explicit:
        - repo: demo
          path: src/auth/session.rs
          symbol: validate_session
    sources:
      demo:
        revision: 2f0c38a
  queue-drain:
    status: current
    review: agent_generated
    anchors:
      inferred:
        - repo: demo
          path: src/auth/token.rs
          symbol: refresh_token
          confidence: 0.9
          provenance: embedding-similarity
---

## Contéxt, owned by the author

<!-- spindrift:managed claim=ledger-order -->
`validate_session` checks expiry.
<!-- /spindrift:managed -->

More prose.

<!-- spindrift:managed claim=queue-drain -->
Rotates the token.
<!-- /spindrift:managed -->
"""


def test_note_round_trip_and_patch():
    n = notes.parse_note(NOTE)
    assert (n.id, n.title, n.schema, sorted(n.claims)) == ("note_authentication", "Authentication", 1, ["ledger-order", "queue-drain"])
    assert n.body("ledger-order") == "`validate_session` checks expiry.\n" and n.claims["queue-drain"].anchors[0]["confidence"] == 0.9
    c = n.claims["ledger-order"]
    assert c.sources == {"demo": "2f0c38a"} and n.with_patch("ledger-order", n.body("ledger-order"), "current", "agent_generated") == NOTE.encode()
    out = n.with_patch("ledger-order", "Neu: ü\n", "stale").decode()
    assert out == NOTE.replace("`validate_session` checks expiry.\n", "Neu: ü\n").replace("status: current", "status: stale", 1)


@pytest.mark.parametrize("change, fault", [
    (("---\n", "--\n", 1), "missing_frontmatter"), (("\n---\n\n##", "\n##"), "unclosed_frontmatter"), (("status: current", "status: odd", 1), "unknown_status"), (("review: agent_generated", "review: odd", 1), "unknown_review"),
    (("claim=queue-drain -->", "claim=other -->"), "unknown_claim"), (("<!-- /spindrift:managed -->\n\nMore", "More"), "malformed_marker"), (("<!-- spindrift:managed claim=queue-drain -->\nRotates the token.\n<!-- /spindrift:managed -->\n", ""), "missing_region"),
    (("Rotates the token.\n<!-- /spindrift:managed -->\n", ""), "unclosed_region"), (("claim=queue-drain -->", "claim=ledger-order -->"), "duplicate_region"), (("spindrift_schema: 1", "spindrift_schema: x"), "malformed_frontmatter")])
def test_note_faults(change, fault):
    with pytest.raises(notes.NoteError, match=fault):
        notes.parse_note(NOTE.replace(*change))


def test_claims_table(spark, tmp_path, rows):
    (tmp_path / "a.md").write_text(NOTE, encoding="utf-8")
    (tmp_path / "b.md").write_text("no front matter", encoding="utf-8")
    c = notes.claims_of(notes.read_notes(spark, str(tmp_path)))
    assert [r[0] for r in rows(c.filter("error IS NULL"), "claim_id")] == ["ledger-order", "queue-drain"] and c.filter("error LIKE 'missing_frontmatter%'").count() == 1
    assert claims.claim(c, "queue-drain").count() == 1
    with pytest.raises(ValueError):
        claims.claims_with_status(c, "odd")


def test_claim_transitions(spark, rows):
    cases = [("explicit direct", None, "direct", "current", "pending_update"), ("0.85", 0.85, "direct", "current", "pending_update"), ("0.84", 0.84, "direct", "current", "stale"), ("0.60", 0.6, "direct", "current", "stale"),
             ("0.59", 0.59, "direct", "current", "current"), ("explicit transitive", None, "transitive", "current", "stale"), ("0.70", 0.7, "transitive", "current", "stale"), ("0.10", 0.1, "direct", "stale", "stale"),
             ("gone", None, "unresolvable", "current", "broken"), ("inferred gone", 0.9, "unresolvable", None, "current"), ("untouched", None, None, "stale", "stale")]
    c = spark.createDataFrame([(n, s) for n, _, _, s, _ in cases] + [("both", "current"), ("no anchor", None)], "claim_id string, status string")
    a = spark.createDataFrame([(n, "r", n, "s", x) for n, x, *_ in cases] + [("both", "r", "gone", "s", None), ("both", "r", "explicit direct", "s", None)], "claim_id string, repo string, path string, symbol string, confidence double")
    hit = spark.createDataFrame([("r", n, "s", res) for n, _, res, _, _ in cases if res], "repo string, path string, symbol string, resolution string")
    assert dict(rows(claims.next_statuses(c, a, hit))) == {n: want for n, *_, want in cases} | {"both": "broken", "no anchor": "current"}


QUEUE = "note_path string, claim_id string, old_claim_snapshot string, changed_evidence_ids array<string>, broken_citations array<string>, allowed_edit_start int, allowed_edit_end int, generation_id string, worktree_base_oid string, worktree_dirty_digest string, queued_at long"


def test_queue_and_patches(spark, rows):
    q = spark.createDataFrame([("n", "c", "{}", ["e"], [], 10, 20, "g", "aa", None, 1), ("n", "c", "{}", ["e"], [], 11, 20, "g", "aa", None, 2), ("n", "c", "{}", ["e"], [], 11, 20, "g", "aa", None, 2), ("m", "d", None, None, None, 0, 1, "old", "aa", None, 1)], QUEUE)
    assert [(r.note_path, r.allowed_edit_start) for r in claims.queued_updates(q).collect()] == [("m", 0), ("n", 11)]
    p = spark.createDataFrame([("n", "c", "see `r@1:p#s:L1`"), ("m", "d", "x"), ("n", "zz", "x")], "note_path string, claim_id string, body string")
    here = spark.createDataFrame([("n", "c", 11, 20), ("m", "d", 0, 1)], "note_path string, claim_id string, region_start int, region_end int")
    now = spark.createDataFrame([("g", "aa", None)], "generation_id string, worktree_base_oid string, worktree_dirty_digest string")
    for allowed, want in (([("r", "p", "s")], None), ([("r", "p", "t")], "citation_not_allowed")):
        got = claims.judged_patches(p, q, here, spark.createDataFrame(allowed, "repo string, path string, symbol string"), now)
        assert {(r.note_path, r.claim_id): r.reject_reason for r in got.collect()} == {("n", "c"): want, ("m", "d"): "stale_generation", ("n", "zz"): "not_queued"}
    moved = claims.judged_patches(p.limit(1), q, here.withColumn("region_end", F.lit(99)), here.limit(0).select(F.lit("").alias("repo"), F.lit("").alias("path"), F.lit("").alias("symbol")), now)
    assert moved.collect()[0].reject_reason == "region_moved"


def test_validation(spark, rows):
    g = spark.createDataFrame([("g",)], "generation_id string")
    f = spark.createDataFrame([("g", "f1"), ("x", "f2")], "generation_id string, file_id string")
    s = spark.createDataFrame([("g", "f1", "s1"), ("g", "f9", "s2")], "generation_id string, file_id string, symbol_id string")
    c = spark.createDataFrame([("g", "f1", "c1")], "generation_id string, file_id string, chunk_id string")
    e = spark.createDataFrame([("g", "f1"), ("g", "f7")], "generation_id string, source_id string")
    assert rows(validation.foreign_keys(g, f, s, c, e)) == [("edges.source", "g/f7"), ("files.generation", "x"), ("symbols.file", "g/f9")]
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, t string")
    assert rows(validation.differences(a, a)) == [] and rows(validation.differences(a, a.distinct())) == [(1, "a", 1)]
    assert rows(validation.upsert_conflicts(spark.createDataFrame([("k", 1, None), ("k", 1, None), ("j", 1, "a"), ("j", 1, None)], "k string, a int, b string"), ["k"])) == [("j", 2, 2)]
    assert rows(validation.ownership(g, "generation_id", "h")) == [(1, 0)]


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(n, value):
    return _varint(n << 3) + _varint(value) if isinstance(value, int) else _varint(n << 3 | 2) + _varint(len(value)) + value


def _index(range_=(0, 3, 9)):
    packed = _field(1, b"".join(map(_varint, range_)))
    occ = [packed + _field(2, b"scip rust demo 1 answer().") + _field(3, 1), packed + _field(2, b"scip rust demo 1 answer()."), _field(1, b"\x01\x00\x04") + _field(2, b"scip rust crate 2.1 other/Part#"), _field(1, b"\x02\x00\x03\x00") + _field(2, b"local 1")]
    info = _field(1, b"scip rust demo 1 answer().") + _field(6, b"answer")
    doc = _field(1, b"src/lib.rs") + _field(4, b"rust") + b"".join(_field(2, o) for o in occ) + _field(3, info)
    return _field(1, b"meta") + _field(2, doc)


def test_scip(spark, rows):
    r = scip.scip_records(spark.createDataFrame([("i", _index())], "source string, content binary"))
    out = scip.imported(r, "repo")
    assert rows(out["symbols"], "name", "start_line", "end_line") == [("answer", 1, 1)]
    assert rows(out["edges"], "edge_kind", "source_line", "target_is_external") == [("defines", 1, False), ("references", 1, False), ("references", 2, True), ("references", 3, True)]
    assert rows(out["unresolved"], "target") == [("scip rust crate 2.1 other/Part#",)]
    lines = spark.createDataFrame([([0, 1, 2],), ([4, 0, 6, 0],), ([4, 0, 6, 1],)], "r array<int>").select(scip.line_range(F.col("r")).alias("x")).collect()
    assert [tuple(x.x) for x in lines] == [(1, 1), (5, 6), (5, 7)]
    with pytest.raises(Exception, match="invalid source range"):
        spark.createDataFrame([([3, 2, 1],)], "r array<int>").select(scip.line_range(F.col("r"))).collect()
    for bad in (b"\x12\xff", b"\x00", _field(2, _field(1, b"\xff")), _index((1, 2, 3, 4, 5))):
        with pytest.raises(scip.Malformed):
            scip.decoded(bad)


def test_checkout_scan(spark, tmp_path, rows):
    for name, data in {"src/a.py": b"def f():\n    return g()\n", "--x.txt": b"x", "semi;x y.txt": b"plus+", "bin.dat": b"a\0b", "bad.txt": b"\xff\xfe1", ".git/config": b"x", "build/o.py": b"x", "empty.py": b""}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = rows(checkout.scan(spark, str(tmp_path), "r", "aa", exclude=["build/"]), "path", "skip_reason")
    assert got == sorted([("src/a.py", None), ("--x.txt", None), ("semi;x y.txt", None), ("bin.dat", "binary"), ("bad.txt", "invalid_utf8"), ("empty.py", None)], key=repr)
    p = spark.createDataFrame([("a/b.log",), ("b.log",), ("keep.log",), ("x/build/y",), ("buildx",), ("d/1.c",)], "p string")
    pick = lambda *g: [r[0] for r in rows(p.filter(checkout.matches_any(F.col("p"), list(g))))]
    assert pick("*.log", "!keep.log") == ["a/b.log", "b.log"] and pick("build") == ["x/build/y"] and pick("/build") == [] and pick("**/b.log") == ["a/b.log", "b.log"] and pick("d/[0-9].c") == ["d/1.c"]


def test_git_output(spark, rows):
    assert checkout.status_records(" M b\0R  new\0old\0?? a\0") == [("a", "?", "?", None), ("b", " ", "M", None), ("new", "R", " ", "old")]
    st = checkout.status_table(spark.createDataFrame([("r", " M b\0")], "repository_id string, raw string"))
    ix = checkout.index_stages(spark.createDataFrame([("r", "100644 abc 0\tb\x00100644 abd 2\tb\0")], "repository_id string, raw string"))
    assert [tuple(x) for x in ix.collect()[0].stages] == [(0, "abc"), (2, "abd")]
    base = spark.createDataFrame([("r", "aa"), ("clean", "bb")], "repository_id string, base_oid string")
    content = spark.createDataFrame([("r", "b", "d1")], "repository_id string, path string, content_digest string")
    got = {r.repository_id: r.revision for r in checkout.worktree_revision(base, st, ix, content).collect()}
    assert got["clean"] == "bb" and got["r"].startswith("aa+dirty.")


@pytest.mark.parametrize("language, source, name", [
    ("python", "import os\nclass A:\n    def run(self):\n        return os.getcwd()\n", "run"), ("rust", "use std::fs;\npub fn run(x: u8) -> u8 {\n    call(x)\n}\n", "run"), ("go", "import \"fmt\"\nfunc run() {\n\tfmt.Println()\n}\n", "run"),
    ("java", "import java.util.List;\npublic class Main {\n  void run() { go(); }\n}\n", "Main"), ("c", "#include <x.h>\nstatic int run(int a) {\n  return call(a);\n}\n", "run"), ("typescript", "import x from 'y';\nexport function run() { call(); }\n", "run"), ("ruby", "require 'x'\ndef run\n  call(1)\nend\n", "run")])
def test_declarations(language, source, name):
    found = ingest.declarations(language, source)
    assert name in {n for w, n, *_ in found if w == "symbol"} and {"imports", "calls"} <= {w for w, *_ in found}


def test_ingest_diagnostics(spark, rows):
    f = spark.createDataFrame([("g", "f1", "r", "a", "notes.txt", None, "text\n\nmore"), ("g", "f2", "r", "a", "broken.py", "python", "def (:"), ("g", "f3", "r", "a", "x.rs", "rust", "fn a() {")], "generation_id string, file_id string, repository_id string, revision string, path string, language string, content string")
    t = ingest.graph_tables(f, ingest.extracted(f))
    assert rows(t["diagnostics"], "path", "code") == [("broken.py", "parse_error"), ("notes.txt", "unknown_language"), ("x.rs", "parse_error")] and t["chunks"].count() == 4


def test_stores(spark, tmp_path, rows):
    reg = store.Registry(tmp_path / "registry.json")
    reg.add("r", str(tmp_path))
    reg.add("r", str(tmp_path))
    with pytest.raises(store.StoreError):
        reg.add("r", str(tmp_path / "other"))
    reg.add("r", str(tmp_path / "other"), alternate=True)
    assert reg.frame(spark).count() == 2
    w = store.WorkspaceStore(tmp_path / "ws")
    w.create("w")
    w.add("w", "b"), w.add("w", "a"), w.add("w", "b"), w.remove("w", "zz")
    assert w.members("w") == ["a", "b"] and w.names() == ["w"]
    for bad in (lambda: w.create("w"), lambda: w.members("no"), lambda: w.create("../x")):
        with pytest.raises(store.StoreError):
            bad()
    g = store.Generations(tmp_path / "gens")
    df = spark.createDataFrame([(1,)], "a int")
    first = g.write({"t": df}, df.limit(0))
    with pytest.raises(store.StoreError):
        g.write({"t": df}, df)
    assert g.current() == first and rows(g.read(spark, "t")) == [(1,)]
    t = store.Traces(tmp_path / "traces.jsonl")
    for i in range(4):
        t.append({"generation_id": str(i), "selected": [], "omitted": [{"entity_id": "e", "reason": "stale"}]})
    assert [r.generation_id for r in t.tail(spark, 2).collect()] == ["2", "3"]
    with pytest.raises(store.StoreError):
        t.append({"diagnostics": ["x" * 70_000]})
    (tmp_path / "c.toml").write_text('schema = 1\nrepository_id = "r"\ninclude = ["src/"]\n[language_overrides]\n"*.inc" = "c"\n')
    assert store.Config.load(tmp_path / "c.toml") == store.Config("r", ("src/",), (), (("*.inc", "c"),))
    (tmp_path / "c.toml").write_text('schema = 1\nrepository_id = "r"\nodd = 1\n')
    with pytest.raises(store.StoreError):
        store.Config.load(tmp_path / "c.toml")
    p = store.PersonalNotes(tmp_path / "mine")
    n = p.create('a "b"')
    assert p.ids() == [n] and rows(notes.personal_notes(spark, str(tmp_path / "mine")), "note_id", "title") == [(n, 'a "b"')]
    assert p.promote(n, tmp_path / "out.md").startswith("--- /dev/null") and not (tmp_path / "out.md").exists()
    p.promote(n, tmp_path / "out.md", confirm=True)
    (tmp_path / "out.md").write_text("changed")
    with pytest.raises(store.StoreError):
        p.promote(n, tmp_path / "out.md", confirm=True)


def test_engine(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src/a.py").write_text("def validate_session(x):\n    return expire(x)\n")
    (repo / "notes").mkdir()
    (repo / "notes/n.md").write_text(NOTE.replace("demo", "r").replace("src/auth/session.rs", "src/a.py"), encoding="utf-8")
    e = engine.Engine(spark, str(tmp_path / "state"))
    gen = e.index(str(repo), store.Config("r", exclude=("notes/",)), "ab12")
    assert e.health()["healthy"] and e.health()["counts"]["symbols"] == 1
    out = e.search(engine.Request("validate_session"))[0]
    assert json.loads(out["packet"])["items"][0]["citation"]["revision"] == {"base_oid": "ab12", "dirty_digest": None} and e.traces(5).count() == 1
    assert e.read("src/a.py", 2, 2, "ab12") == "    return expire(x)"
    for a in (("src/a.py", 2, 9, "ab12"), ("src/a.py", 1, 1, "other"), ("no", 1, 1, "ab12")):
        with pytest.raises(LookupError):
            e.read(*a)
    assert e.claims(str(repo / "notes")).count() == 2
    note = str(repo / "notes/n.md")
    n = notes.parse_note(open(note, "rb").read())
    a, b = n.claims["ledger-order"].region
    q = spark.createDataFrame([(note, "ledger-order", "{}", [], [], a, b, gen, "ab12", None, 1)], QUEUE)
    now = spark.createDataFrame([(gen, "ab12", None)], "generation_id string, worktree_base_oid string, worktree_dirty_digest string")
    with pytest.raises(ValueError, match="citation_not_allowed"):
        e.apply_update(note, "ledger-order", "`r@ab12:src/a.py#other:L1`", q, now)
    assert e.apply_update(note, "ledger-order", "See `r@ab12:src/a.py#validate_session:L1`.\n", q, now, status="current").count() == 0
    assert "See `r@ab12" in open(note, encoding="utf-8").read()
    w = engine.Workspace({"r": e}, ["r", "missing"])
    items, missing = w.search(engine.Request("validate_session"))
    assert items[0]["repository"] == "r" and missing == ["missing"]


EVENT = "source string, seq long, ts timestamp, kind string, paths array<string>, message string"


def events(spark, *e):
    t0 = datetime(2025, 1, 1)
    return spark.createDataFrame([("s", i, t0 + timedelta(milliseconds=ms), k, p, m) for i, (ms, k, p, m) in enumerate(e)], EVENT)


def test_coalescing(spark):
    e = events(spark, (0, "modify", ["a"], None), (100, "modify", ["b", "a"], None), (150, "access", ["z"], None), (2000, "create_dir", ["d"], None), (4000, "modify", [f"p{i}" for i in range(65)], None), (6000, "error", None, "x" * 2000),
               (8000, "modify", ["../out"], None), (9000, "modify", [".git/x"], None), (10_000, "rescan", None, None))
    got = watch.coalesced(watch.classified(e)).orderBy("started").collect()
    assert [(r.paths, r.full_scan, r.overflow, r.n_events) for r in got] == [(["a", "b"], False, False, 2), ([], True, False, 1), ([], True, True, 1), ([], True, False, 1), ([], True, True, 1), ([], True, True, 1)]
    assert len(got[3].fault) == 1024
    many = watch.coalesced(watch.classified(events(spark, *[(i, "modify", [f"p{i}"], None) for i in range(257)]))).collect()[0]
    assert many.paths == [] and many.full_scan


def test_stream_rebuilds_with_retry(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"source": "s", "seq": i, "ts": f"2025-01-01T00:00:{i * 20:02d}", "kind": "modify", "paths": [f"p{i}"], "message": None} for i in range(3)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema(EVENT).json(str(src))
    calls, naps = [], []

    def rebuild(paths, full):
        calls.append((paths, full))
        if len(calls) == 1:
            raise OSError("busy")

    q = watch.rebuild_on_change(watch.coalesced_stream(watch.classified(stream), lateness="1 second"), rebuild, str(tmp_path / "ck"), sleep=naps.append)
    q.processAllAvailable()
    q.stop()
    assert naps == [0.25] and calls[0][0] == calls[-1][0] == ["p0", "p1"] and calls[-1][1]


def test_retry_gives_up():
    r = watch.Retry()
    b = {"paths": ["a"], "full_scan": False, "diagnostics": ["x"]}
    assert [r.failed(b, True) for _ in range(4)] == [0.25, 0.5, 0.75, None] and watch.Retry().failed(b, False) is None
    assert r.prepared({"paths": ["b"], "full_scan": False, "diagnostics": ["x", "y"]}) == {"paths": ["a", "b"], "full_scan": True, "diagnostics": ["x", "y"]}


def test_islands(spark):
    e = spark.createDataFrame([("u", datetime(2025, 1, 1, 0, 0, s)) for s in (0, 5, 5, 30)], "u string, ts timestamp")
    assert sorted(r.n_events for r in watch.islands(e, "u", "ts", 10).collect()) == [1, 3]
