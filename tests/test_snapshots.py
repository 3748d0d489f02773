from datetime import datetime

import pytest

from spindrift.operators import snapshots as S

GEN = "generation_id string, repository_id string, status string, sealed_at timestamp, started_at timestamp, seq string"
FILE = "generation_id string, file_id string, content_digest string, delivered_at timestamp, seq string, k1 string, change string, repository_id string"


def t(n):
    return datetime(2025, 1, 1, 0, 0, n)


@pytest.fixture
def history(spark):
    gens = [("z1", "r", "sealed", t(1), None, "x"), ("a2", "r", "sealed", t(2), None, "x"), ("b", "r", "building", None, None, "x"), ("m3", "r", "sealed", t(3), None, "x"), ("e4", "r", "sealed", t(4), None, "x"), (None, "r", "sealed", t(5), None, "x")]
    files = [
        ("z1", "f1", "AB", t(1)), ("z1", "f2", "cc", t(1)), ("z1", "f3", None, t(1)),
        ("a2", "f1", "sha:ab", t(1)), ("a2", "f2", "dd", t(2)), ("a2", "f2", "cc", t(9)), ("a2", "f3", None, t(1)), ("a2", "f4", "x", None), ("a2", "f4", "y", t(1)),
        ("b", "f9", "x", t(1)), ("m3", "f1", "zz", t(1)), ("m3", "f4", "y", t(1)), ("m3", None, "y", t(1)), (None, "f1", "y", t(1)),
    ]
    f = spark.createDataFrame([(*x, "c", "c", "c", "other") for x in files] * 2, FILE)
    return f, spark.createDataFrame(gens * 2, GEN)


WANT = [
    ("a2", "f4", "added", None, "y"), ("e4", "f1", "removed", "zz", None), ("e4", "f4", "removed", "y", None),
    ("m3", "f1", "changed", "ab", "zz"), ("m3", "f2", "removed", "cc", None), ("m3", "f3", "removed", None, None),
]


@pytest.mark.parametrize("bucket", [1, 1000])
def test_changes_with_late_repeated_null_and_clashing(history, rows, bucket):
    assert rows(S.snapshot_changes(*history, bucket_rows=bucket)) == sorted(WANT, key=repr)


def test_unconfirmed(spark, history, rows):
    q = spark.createDataFrame([("a2", ["f4", "f1", None, "f1"]), ("a2", None), ("a2", []), ("z1", ["f1"]), (None, ["f1"]), ("nowhere", ["f8"])] * 2, "generation_id string, changed_evidence_ids array<string>")
    got = rows(S.unconfirmed_evidence(q, S.snapshot_changes(*history)), "generation_id", "evidence_id")
    assert got == [("a2", "f1"), ("nowhere", "f8"), ("z1", "f1")]


def test_empty_tables(spark, history, rows):
    f, g = history
    assert rows(S.snapshot_changes(f.limit(0), g)) == []
    assert rows(S.snapshot_changes(f, g.limit(0))) == []


def test_report(history, rows):
    assert ("e4", "removed", 2) in rows(S.change_report(S.snapshot_changes(*history)))


def test_hot_repository_spreads_over_buckets(spark):
    f = spark.range(3000).selectExpr("'z1' AS generation_id", "concat('f', id) AS file_id", "'x' AS content_digest", "timestamp'2025-01-01' AS delivered_at")
    g = spark.createDataFrame([("z1", "r", "sealed", t(1), None, ""), ("a2", "r", "sealed", t(2), None, "")], GEN)
    assert S.snapshot_changes(f, g, bucket_rows=100).count() == 3000
