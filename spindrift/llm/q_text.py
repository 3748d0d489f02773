"""Queries on texts, with SQL where it can state the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.llm import handwritten, shared_spans, splitting
from spindrift.tables import table


def _pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks").select("chunk_id", "text", "start_line"))


def p2_found(spark, d):
    return _pieces(spark, d).select(F.col("item").alias("chunk_id")).distinct()


def p2_pieces(spark, d):
    return _pieces(spark, d)


def p2_check(spark, d):
    """Every text put together again from its pieces without what they repeat."""
    rest = F.expr("substring(encode(text, 'UTF-8'), overlap_bytes + 1)")
    pieces = _pieces(spark, d).withColumn("rest", rest)
    return pieces.groupBy(F.col("item").alias("chunk_id"), "version").agg(
        F.max("end_byte").alias("n_bytes"), F.max(F.octet_length("text") > splitting.LIMIT).alias("too_long"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "rest"))), lambda x: F.hex(x["rest"])), "")).alias("hex_md5")).drop("version")


def p2_report(spark, d):
    return splitting.split_report(_pieces(spark, d))


def _records(spark, d):
    return shared_spans.records_of((table(spark, d, "chunks"), "chunk_id", "text"), (table(spark, d, "lexical_docs"), "entity_id", "body"))


def p5_found(spark, d):
    return shared_spans.shared_spans(_records(spark, d))


def p5_report(spark, d):
    records = _records(spark, d)
    return shared_spans.shared_report(records, shared_spans.shared_spans(records))


def _judged(spark, d):
    return handwritten.judged_files(table(spark, d, "files"), table(spark, d, "chunks"), table(spark, d, "vendor_releases"))


def p6_found(spark, d):
    return handwritten.not_handwritten(_judged(spark, d))


def p6_reasons(spark, d):
    return _judged(spark, d)


QUERIES = {
    "p6_found": p6_found, "p6_reasons": p6_reasons,
    "p5_found": p5_found, "p5_report": p5_report,
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_check": p2_check, "p2_report": p2_report}

_SHARED = """
r AS (SELECT chunk_id AS id, text AS t FROM chunks WHERE text IS NOT NULL UNION SELECT entity_id, body FROM lexical_docs WHERE body IS NOT NULL),
w AS (SELECT id, p, hash(substr(t, p + 1, 120)) AS h, md5(substr(t, p + 1, 120)) AS m FROM (SELECT id, t, unnest(range(length(t) - 119)) AS p FROM r WHERE length(t) >= 120)),
s AS (SELECT h, m FROM w GROUP BY h, m HAVING min(id) <> max(id)),
x AS (SELECT w.id, w.p, w.p + 120 AS e FROM w JOIN s ON w.h = s.h AND w.m = s.m),
y AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY id ORDER BY p) + 120 THEN 0 ELSE 1 END AS n FROM x),
z AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY p) AS g FROM y),
f AS (SELECT id AS record_id, min(p)::INT AS span_start, max(e)::INT AS span_end FROM z GROUP BY id, g)
"""

SQL = {
    "p5_found": f"WITH {_SHARED} SELECT * FROM f",
    "p5_report": f"""WITH {_SHARED} SELECT r.id AS record_id, max(length(r.t)) AS n_chars, coalesce(max(a.n), 0) AS n_spans, coalesce(max(a.c), 0) AS shared_chars
      FROM r LEFT JOIN (SELECT record_id, count(*) AS n, sum(span_end - span_start) AS c FROM f GROUP BY 1) a ON a.record_id = r.id GROUP BY 1""",
    "p2_check": "SELECT DISTINCT chunk_id, octet_length(encode(text)) AS n_bytes, false AS too_long, md5(hex(encode(text))) AS hex_md5 FROM chunks WHERE octet_length(encode(text)) > 8192",
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE octet_length(encode(text)) > 8192"}
