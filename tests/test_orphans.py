from datetime import datetime

import pytest

from spindrift.operators import orphans as O

T = datetime(2025, 3, 5)
GEN = "generation_id string, repository_id string, status string, started_at timestamp, sealed_at timestamp, key string, repo string"


@pytest.fixture
def graph(spark):
    gens = spark.createDataFrame([(g, "r", s, datetime(2025, 1, d), datetime(2025, 1, d) if s == "sealed" else None, "k", "k") for g, s, d in (("c1", "sealed", 1), ("b2", "sealed", 2), ("a3", "sealed", 3), ("x", "building", 2))] * 2, GEN)
    files = spark.createDataFrame([("c1", "file_old", 1), ("b2", "file_now", 1), ("a3", "file_new", 1), ("x", "file_half", 1), (None, "file_n", 1), ("b2", None, 1)], "generation_id string, file_id string, gno int")
    symbols = spark.createDataFrame([("b2", "symbol_a", "scip a"), ("b2", "symbol_b", None)], "generation_id string, symbol_id string, scip_symbol string")
    chunks = spark.createDataFrame([("b2", "chunk_a")], "generation_id string, chunk_id string")
    edges = spark.createDataFrame([
        (1, "b2", "file_now", False, T), (2, "b2", "file_old", False, T), (3, "b2", "file_new", None, T), (4, "b2", "file_half", False, T), (5, "b2", "os.path", True, T),
        (6, "b2", "os.path", None, T), (7, "b2", None, False, T), (8, "b2", "", False, None), (9, "b2", "chunk_a", None, T), (10, "b2", "symbol_zz", False, T), (11, "nowhere", "file_now", False, T),
        (12, None, "file_now", False, T), (None, "b2", "file_gone", False, T)] * 2, "edge_id long, generation_id string, target string, target_is_external boolean, observed_at timestamp")
    ex = spark.createDataFrame([(1, ["scip a", "scip b", "scip b", "local 1", None, "scip p"], T), (2, None, T), (3, [], None), (4, ["SCIP A", ""], None)] * 2, "extraction_id long, unresolved_external_symbols array<string>, imported_at timestamp")
    packages = spark.createDataFrame([("scip p",), (None,)], "scip_symbol string")
    return edges, files, symbols, chunks, gens, ex, packages


def test_reasons(graph, rows):
    got = rows(O.orphan_references(*graph).distinct(), "source_table", "source_key", "target", "reason")
    assert got == sorted([
        ("edges", 2, "file_old", "deleted"), ("edges", 3, "file_new", "late"), ("edges", 4, "file_half", "missing"), ("edges", 8, "", "missing"), ("edges", 10, "symbol_zz", "missing"),
        ("edges", 11, "file_now", "missing"), ("edges", None, "file_gone", "missing"), ("scip_extractions", 1, "scip b", "missing"), ("scip_extractions", 4, "SCIP A", "missing"), ("scip_extractions", 4, "", "missing")], key=repr)


def test_report_counts_distinct_by_month(graph, rows):
    got = rows(O.orphan_report(O.orphan_references(*graph)))
    assert ("edges", "2025-03", "deleted", 1) in got and ("edges", None, "missing", 1) in got and ("scip_extractions", None, "missing", 2) in got


def test_empty(graph, rows):
    edges, files, symbols, chunks, gens, ex, packages = graph
    assert rows(O.orphan_references(edges.limit(0), files, symbols, chunks, gens, ex.limit(0), packages)) == []
    n = O.orphan_references(edges, files.limit(0), symbols.limit(0), chunks.limit(0), gens.limit(0), ex, packages.limit(0)).filter("source_table = 'edges'").select("source_key").distinct().count()
    assert n == 9
