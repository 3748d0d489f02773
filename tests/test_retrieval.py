import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift import engine
from spindrift.operators import contradiction, exact, federation, flat_vectors, fusion, graph, lexical, metrics, packet, resolve

DOC = "entity_id string, repository string, revision string, path string, language string, symbol string, body string, start_line int, end_line int, kind string"
DOCS = [
    ("c1", "r", "aa", "src/frame_reader.rs", "rust", None, "fn read_frame_header() { FrameReader::next(); }", 1, 3, "chunk"),
    ("c2", "r", "aa", "notes/archive.md", "markdown", None, "A patient archivist sorts every ledger twice.", 5, 5, "chunk"),
    ("s1", "r", "aa", "src/frame_reader.rs", "rust", "FrameReader", "struct FrameReader;", 7, 7, "symbol"),
    ("n1", "r", "aa", None, None, None, None, None, None, "chunk"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS * 2, DOC)


def asked(spark, *queries):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "query_id string, query string")


def test_lexical_and_exact(spark, docs, rows):
    d = lexical.distinct_documents(docs)
    assert rows(lexical.bm25(d, asked(spark, "patient ledger", "nothing here")), "query_id", "entity_id", "rank") == [("0", "c2", 1)]
    assert d.count() == 4 and exact.by_path(d, "src/frame_reader.rs").count() == 2 and exact.by_symbol(d, "FrameReader").count() == 1
    assert rows(exact.by_identifier(d, "read_frame_header"), "entity_id") == [("c1",)] and exact.by_identifier(d, "two words").count() == 0
    assert rows(exact.identifier_pool(d, asked(spark, "read_frame_header other")), "entity_id") == [("c1",)]


def test_stored_index_gives_the_same(spark, docs, rows):
    index = lexical.stored_index(docs)
    q = asked(spark, "patient ledger", "frame reader", "nothing here")
    d = lexical.distinct_documents(docs)
    got = rows(lexical.bm25(d, q, index=(index["postings"], index["lexical_stats"])))
    assert got == rows(lexical.bm25(d, q)) and got
    assert rows(lexical.postings(d.filter("entity_id = 'n1'"))) == []


def test_bm25_ties_by_path(spark, rows):
    d = spark.createDataFrame([(e, "r", "a", p, "x", None, "same words", 1, 1, "chunk") for e, p in (("b", "p2"), ("a", "p2"), ("z", "p1"))], DOC)
    assert [r.entity_id for r in lexical.bm25(d, asked(spark, "words")).orderBy("rank").collect()] == ["z", "a", "b"]
    assert lexical.bm25(d.limit(0), asked(spark, "words")).count() == 0


def test_fusion(spark, rows):
    def pool(name, *ids):
        return spark.createDataFrame([("q", name, e, i + 1) for i, e in enumerate(ids)], "query_id string, pool string, entity_id string, rank int")

    out = fusion.fuse(fusion.pools_union(pool("lexical", "a", "b"), pool("exact_path", "b"))).orderBy("rank").collect()
    assert [r.entity_id for r in out] == ["b", "a"] and out[0].score == pytest.approx(1 / 3 / 62 + 2 / 3 / 61, abs=1e-8)
    assert [x.scorer for x in out[0].explanations] == ["lexical", "exact_path"] and out[1].explanations[0].explanation == "w=0.333,r=1"
    many = pool("lexical", *[f"e{i:03}" for i in range(257)])
    with pytest.raises(Exception, match="too many candidates"):
        fusion.bounded(many).count()
    assert fusion.bounded(many, on_overflow="truncate").count() == 256


def test_two_hops(spark, rows):
    e = spark.createDataFrame([("g", "f1", "a", False), ("g", "f1", "b", False), ("g", "f2", "b", None), ("g", "f2", "x", True), ("h", "f1", "zz", False), ("g", "f1", None, False), ("g", "a", "a", False)] * 2,
                              "generation_id string, source_id string, target string, target_is_external boolean")
    seeds = spark.createDataFrame([("q", "g", "a"), ("q", "g", None)], "query_id string, generation_id string, node string")
    assert rows(graph.within_hops(seeds, graph.inner_edges(e)), "entity_id") == [("b",), ("f1",)]


def test_enclosing_chunk_is_smallest_then_least(spark, rows):
    s = spark.createDataFrame([("g", "s1", "f", 3, 4), ("g", "s2", "f", 3, 9), ("g", "s3", "f", None, 4)], "generation_id string, symbol_id string, file_id string, start_line int, end_line int")
    c = spark.createDataFrame([("f", "c9", 1, 8), ("f", "c2", 3, 5), ("f", "c1", 2, 4), ("f", "c0", None, 4)], "file_id string, chunk_id string, start_line int, end_line int")
    assert rows(resolve.enclosing_chunks(s, c), "symbol_id", "chunk_id") == [("s1", "c1")]


def test_reasons(spark, rows):
    agree = ("r", "a", "src/x", "rust", "chunk", None, 1, 2)
    cols = "repository string, revision string, path string, language string, kind string, symbol string, start_line int, end_line int"
    resolved = spark.createDataFrame([("ok", *agree, "text"), ("moved", *agree[:6], 1, 9, "text"), ("null", *agree, None), ("blank", *agree, " \n\t"), ("other", "r", "a", "lib/x", "rust", "chunk", None, 1, 2, "t")], f"entity_id string, {cols}, content string")
    cand = spark.createDataFrame([("q", e, *agree) for e in ("ok", "moved", "null", "blank", "gone")] + [("q", "other", "r", "a", "lib/x", "rust", "chunk", None, 1, 2)], f"query_id string, entity_id string, {cols}")
    req = spark.createDataFrame([("q", None, None, "src/", None, ["chunk"])], "query_id string, f_repository string, f_revision string, f_path_prefix string, f_language string, f_kinds array<string>")
    assert rows(resolve.with_reasons(cand, resolved, req), "entity_id", "reason") == sorted([("ok", None), ("moved", "metadata_disagreement"), ("null", "unresolvable"), ("blank", "empty"), ("gone", "stale"), ("other", "metadata_filter")], key=repr)


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), max_size=12))
def test_diversified_is_a_permutation(items):
    order = packet.diversified([p for p, _ in items], [s for _, s in items])
    assert sorted(order) == list(range(len(items)))
    firsts = list(dict.fromkeys(p for p, _ in items))[:3]
    assert [items[i][0] for i in order[: len(firsts)]] == firsts


def test_diversity_limits_paths_and_symbols():
    assert packet.diversified(["a", "a", "a", "b", "a"], [None] * 5) == [0, 3, 1, 2, 4]
    assert packet.diversified(["a", "b", "c", "d", "e"], ["s"] * 5) == [0, 1, 2, 3, 4]


def test_contradiction(spark, rows):
    assert contradiction.contradictory(["the cache is enabled here", "the cache is disabled here"])
    assert not contradiction.contradictory(["must rotate keys", "must not reuse keys"])
    assert not contradiction.contradictory(["enabled", "disabled"])
    items = spark.createDataFrame([("q", 1, "the cache is enabled here"), ("q", 2, "the cache is disabled here"), ("p", 3, "the cache is disabled here"), ("q", 4, None)], "query_id string, position int, content string")
    assert rows(contradiction.contradictions(items)) == [("q", 1, 2)]


def test_federation(spark, rows):
    r = spark.createDataFrame([("q", "repo.a", 0, 0.9, "a-high"), ("q", "repo.a", 1, 0.9, "a-high-2"), ("q", "repo.a", 2, 0.5, "a-low"), ("q", "repo.b", 0, 0.9, "b-high")], "query_id string, repository string, local_rank int, score double, item string")
    assert [x.item for x in federation.federated(r).orderBy("merged_rank").collect()] == ["a-high", "a-high-2", "b-high", "a-low"]
    m = spark.createDataFrame([("repo.a",), ("repo.missing",)], "repository string")
    assert rows(federation.unresolved_members(m, r)) == [("repo.missing",)]


def test_flat_vectors(spark, rows):
    v = spark.createDataFrame([("entity_axis_x", [1.0, 0.0]), ("entity_axis_y", [0.0, 1.0]), ("entity_diagonal", [1.0, 1.0]), ("entity_opposite_x", [-1.0, 0.0]), ("bad", [1.0]), ("none", None), ("nan", [float("nan"), 1.0]), (None, [1.0, 0.0])], "entity_id string, embedding array<float>")
    out = flat_vectors.top_k(v, [("q", [1.0, 0.0])], 4).orderBy("rank").collect()
    assert [r.entity_id for r in out] == ["entity_axis_x", "entity_diagonal", "entity_axis_y", "entity_opposite_x"] and (out[0].cosine, out[3].cosine) == (1.0, -1.0)
    for k, q in ((0, [1.0, 0.0]), (1, [])):
        with pytest.raises(ValueError):
            flat_vectors.top_k(v, [("q", q)], k)
    assert {x[1] for x in rows(flat_vectors.vector_violations(v, 2))} == {"bad id", "wrong length", "not finite"}
    p = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "t array<array<double>>, m array<double>")
    r = p.select(flat_vectors.mean_pooled(F.col("t"), F.col("m")).alias("mean"), flat_vectors.cls_pooled(F.col("t")).alias("cls"), flat_vectors.normalized(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).collect()[0]
    assert (r.mean, r.cls, r.n) == ([2.0, 3.0], [1.0, 2.0], [0.6, 0.8])


def test_metrics(spark, rows):
    rank = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 11)], "query_id string, entity_id string, rank int")
    j = spark.createDataFrame([("q", "b", 3), ("q", "c", 1), ("q", "x", 0), ("p", "a", 0)], "query_id string, entity_id string, gain int")
    import math

    got = {r.query_id: r for r in metrics.ranking_quality(rank, j).collect()}
    assert got["q"].recall == 0.5 and got["q"].ndcg == pytest.approx(7 / math.log2(3) / (7 + 1 / math.log2(3))) and got["p"].recall is None


def graph_of(spark, files):
    """(docs, files, symbols, chunks, edges) of one generation for path -> content."""
    from spindrift.sources import ingest

    f = spark.createDataFrame([("g", f"file_{i}", "repo", "ab12", p, "python" if p.endswith(".py") else "rust" if p.endswith(".rs") else None, c) for i, (p, c) in enumerate(files.items())],
                              "generation_id string, file_id string, repository_id string, revision string, path string, language string, content string")
    t = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in ingest.graph_tables(f, ingest.extracted(f)).items()}
    docs = ingest.lexical_documents(f, t["chunks"], t["symbols"])
    return spark.createDataFrame(docs.collect(), docs.schema), f.drop("content"), t["symbols"], t["chunks"], t["edges"]


def run(spark, tables, *requests, **kw):
    return {r.query_id: r for r in engine.search(engine.requests_frame(spark, list(requests)), *tables, **kw).collect()}


def test_search_end_to_end(spark):
    tables = graph_of(spark, {"src/parser.py": "def parse_request(raw):\n    return raw\n", "guide.md": "The guide validates parse_request here.\n\nA second paragraph says more.\n"})
    got = run(spark, tables, engine.Request("parse_request src/parser.py validates", "a", language="python", path_prefix="src/"), engine.Request("second", "g"), engine.Request("qqqq", "none"))
    p = json.loads(got["a"].packet)
    assert p["items"] and all(i["citation"]["path"].startswith("src/") for i in p["items"]) and "metadata_filter" in {o.reason for o in got["a"].omitted}
    assert {"exact_path", "exact_symbol", "exact_identifier"} <= {x["scorer"] for i in p["items"] for x in i["score_explanations"]}
    assert len(json.loads(got["g"].packet)["items"]) == 2  # the other paragraph comes through the graph
    none = json.loads(got["none"].packet)
    assert none["items"] == [] and none["diagnostics"][0]["code"] == "no_resolvable_evidence"


def test_search_of_every_repository(spark, tmp_path):
    """The last sealed generation of each repository, by time and not by id, as if it were searched alone."""
    from datetime import datetime
    from functools import reduce

    from spindrift.plans import retrieval

    generations = [("z1", "a", "sealed", 1), ("b2", "a", "sealed", 2), ("c3", "b", "sealed", 3), ("d1", "b", "sealed", 1), ("zz", "b", "building", None), ("a9", "c", "sealed", 9)]
    rows = [(g, repo, status, at and datetime(2025, 1, at)) for g, repo, status, at in generations]
    spark.createDataFrame(rows * 2, "generation_id string, repository_id string, status string, sealed_at timestamp").write.parquet(f"{tmp_path}/generations.parquet")
    parts = {}
    for g, repo, _, _ in generations:
        more = {"note.md": "The queue keeps its prefix.\n\nNothing else is said.\n"} if repo == "a" else {}
        t = graph_of(spark, {"src/s.py": f"def encode_session(raw):\n    return {g!r}\n"} | more)
        own = [reduce(lambda d, c: d.withColumn(c, F.concat(F.lit(f"{g}_"), c)), [c for c in ("entity_id", "file_id", "symbol_id", "chunk_id", "source_id", "target") if c in x.columns], x) for x in t]
        own = [x.withColumn("generation_id", F.lit(g)) for x in own]
        own[1] = own[1].withColumn("repository_id", F.lit(repo))
        parts[g] = own
    for i, name in enumerate(("lexical_docs", "files", "symbols", "chunks", "edges")):
        reduce(lambda a, b: a.unionByName(b), [p[i] for p in parts.values()]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = retrieval.search_packets(spark, str(tmp_path)).collect()
    last = {"a": "b2", "b": "c3", "c": "a9"}
    assert {(r.query_id, r.repository, r.generation_id) for r in got} == {(q, *x) for q, _ in retrieval.QUERIES_ASKED for x in last.items()}
    for repo, g in last.items():
        _, files, symbols, chunks, edges = parts[g]
        r = resolve.resolved_entities(files, symbols, chunks).filter("kind <> 'file'").withColumnRenamed("content", "body")
        alone = run(spark, (r, files, symbols, chunks, edges), *[engine.Request(q, i) for i, q in retrieval.QUERIES_ASKED], on_overflow="truncate")
        for x in got:
            if x.repository == repo:
                w = alone[x.query_id]
                assert (x.packet, x.n_bytes, x.selected, sorted(x.omitted)) == (w.packet, w.n_bytes, w.selected, sorted(w.omitted))
    found = sorted((x for x in got if x.query_id == "q2"), key=lambda x: x.repository)
    assert all(json.loads(x.packet)["items"] and x.generation_id in x.packet for x in found)
    ranks = [m for x in found for m in x.merged_ranks]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and [len(x.merged_ranks) for x in found] == [len(json.loads(x.packet)["items"]) for x in found]
    assert all(x.merged_ranks == [] for x in got if x.query_id == "q10")


def test_budget_and_contradiction(spark):
    long = {f"f{i}.md": "alpha " + ("word " * 400 + "\n\n") for i in range(5)}
    tables = graph_of(spark, long | {"on.md": "the beta cache is enabled today\n", "off.md": "the beta cache is disabled today\n"})
    got = run(spark, tables, engine.Request("alpha", "small", budget=1000), engine.Request("alpha", "large", budget=32_000), engine.Request("beta", "c"))
    assert got["small"].n_bytes <= 1000 and "budget" in {o.reason for o in got["small"].omitted}
    assert got["large"].n_bytes <= 32_000 and len(json.loads(got["large"].packet)["items"]) >= 3
    assert "contradictory_evidence" in {d["code"] for d in json.loads(got["c"].packet)["diagnostics"]}


def test_request_bounds(spark):
    for r in (engine.Request("q", budget=999), engine.Request("q", max_results=101), engine.Request("  ")):
        with pytest.raises(ValueError):
            r.row()


def test_frame_fitting():
    frame = {"items": [{"content": "a\n\n" + "b" * 50}, {"content": "c" * 50}], "diagnostics": [{"code": "x"}]}
    out = packet.frame_fitted(frame, 110)
    assert len(json.dumps(out, separators=(",", ":")).encode()) <= 110 and out["items"][0]["content"] == frame["items"][0]["content"]
