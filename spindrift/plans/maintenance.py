"""Queries on generations, claims, updates and events, with SQL that states the same result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import excerpts
from spindrift.functions.text import citations
from spindrift.operators import claims, resolve, snapshots, validation
from spindrift.sources import ingest
from spindrift.sources.store import ordered_tail
from spindrift.streaming import watch
from spindrift.tables import arrow_batches, table

TABLES = ("generations", "files", "symbols", "chunks", "edges", "lexical_docs", "update_queue")


def _all(spark, d, *names):
    return [table(spark, d, n) for n in names]


def table_counts(spark, d):
    return validation.table_counts(**{n: table(spark, d, n) for n in TABLES})


def ownership_check(spark, d):
    return validation.ownership(table(spark, d, "generations"), "status", "sealed")


def fk_orphans(spark, d):
    """References of sealed and abandoned generations against the sealed ones, and against files whose size is known."""
    generations, files, symbols, chunks, edges = _all(spark, d, "generations", "files", "symbols", "chunks", "edges")
    sealed = generations.filter("status = 'sealed'")
    known = files.filter("n_bytes IS NOT NULL")
    return validation.orphans(files, ["generation_id"], sealed, "files.generation").unionByName(validation.foreign_keys(generations, known, symbols, chunks, edges))


def entity_consistency(spark, d):
    """Entities are what edges name; rows are what the tables hold."""
    files, symbols, chunks, edges = _all(spark, d, "files", "symbols", "chunks", "edges")
    named = edges.filter("target IS NOT NULL AND NOT coalesce(target_is_external, true)").select("generation_id", F.col("target").alias("entity_id"), F.regexp_extract("target", "^([a-z]+)_", 1).alias("entity_kind"))
    return validation.entity_consistency(named, files, symbols, chunks).groupBy("violation").agg(F.count("*").alias("n"))


def index_equality(spark, d):
    """Symbols of the lexical index against those of the graph, as multisets."""
    docs, symbols = _all(spark, d, "lexical_docs", "symbols")
    a = docs.filter("kind = 'symbol'").select("entity_id", "symbol", "start_line", "end_line").distinct()
    b = symbols.select(F.col("symbol_id").alias("entity_id"), F.col("name").alias("symbol"), "start_line", "end_line").distinct()
    return validation.differences(a, b).groupBy("surplus").agg(F.count("*").alias("n"))


def upsert_conflicts(spark, d):
    f = table(spark, d, "files").select("generation_id", "file_id", "path", "language", "content_digest")
    return validation.upsert_conflicts(f, ["generation_id", "file_id"])


def idempotent_rows(spark, d):
    return validation.idempotent(table(spark, d, "edges")).groupBy("edge_kind").agg(F.count("*").alias("n_rows"), F.sum("source_line").alias("lines"))


def order_violations(spark, d):
    f = table(spark, d, "files").select("generation_id", "path", "delivered_at", "file_id").distinct()
    return resolve.ordered_without_gap(f.withColumn("at", F.struct("delivered_at", "file_id", "path")), "generation_id", "at", "path").groupBy("generation_id").agg(F.count("*").alias("n"))


def queued_updates(spark, d):
    q = claims.queued_updates(table(spark, d, "update_queue"))
    return q.select("note_path", "claim_id", "queued_at", "generation_id", "allowed_edit_start", "allowed_edit_end", F.array_join("broken_citations", " ").alias("broken"))


def claim_transition(spark, d):
    """Claims of the queue after the changes of their generation.

    A changed file touches its claim directly, an added one transitively, a
    removed one cannot be resolved. Anchors with broken citations are inferred.
    """
    q = table(spark, d, "update_queue")
    changes = snapshots.snapshot_changes(table(spark, d, "files"), table(spark, d, "generations"))
    resolution = F.when(F.col("change") == "changed", "direct").when(F.col("change") == "added", "transitive").otherwise("unresolvable")
    affected = changes.select(F.col("generation_id").alias("repo"), F.col("file_id").alias("path"), F.lit("").alias("symbol"), resolution.alias("resolution"))
    known = q.groupBy("claim_id").agg(F.max(F.get_json_object("old_claim_snapshot", "$.status")).alias("status"))
    anchors = q.select("claim_id", F.col("generation_id").alias("repo"), F.explode("changed_evidence_ids").alias("path"), F.lit("").alias("symbol"),
                       F.when(F.size("broken_citations") > 0, F.lit(0.7)).alias("confidence"))
    return claims.next_statuses(known, anchors, affected)


def citation_allowlist(spark, d):
    return claims.allowed_citations(*_all(spark, d, "files", "symbols"))


def broken_citations(spark, d):
    q = table(spark, d, "update_queue").select("note_path", "claim_id", F.explode("broken_citations").alias("text")).distinct()
    return q.select("note_path", "claim_id", "text", F.explode(citations(F.col("text"))).alias("c")).select("note_path", "claim_id", "text", "c.repo", "c.path", "c.symbol")


def session_coalesce(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit("modify").alias("kind"),
        F.array(F.concat(F.lit("src/"), "event_type")).alias("paths"), F.lit(None).cast("string").alias("message"))
    out = watch.coalesced(watch.classified(e), quiet_ms=3_600_000)
    return out.select("source", F.col("started").cast("timestamp_ntz").alias("started"), F.array_join("paths", " ").alias("paths"), "full_scan", "n_events")


def event_islands(spark, d):
    return watch.islands(table(spark, d, "events"), "user_id", "ts", 3600).select("user_id", "island", "started", "ended", "n_events")


def event_tail(spark, d):
    return ordered_tail(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "ts", 100, "event_id")


def reference_chunks(spark, d):
    """Runs of lines of every text, as ingestion cuts them."""
    arrow_batches(spark, 500)

    def run(frames):
        for f in frames:
            rows = [(i, a, b, t) for i, text in zip(f.chunk_id, f.text) for a, b, t in ingest.chunked(text or "")]
            yield pd.DataFrame(rows, columns=["chunk_id", "start_line", "end_line", "text"])

    return table(spark, d, "chunks").select("chunk_id", "text").distinct().mapInPandas(run, "chunk_id string, start_line int, end_line int, text string")


def ingested(spark, d):
    """Symbols, edges and diagnostics that ingestion finds in the project's own texts."""
    f = table(spark, d, "files").filter("generation_id IS NOT NULL").groupBy("file_id").agg(F.max(F.lower("language")).alias("language"))
    c = table(spark, d, "chunks").select("generation_id", "file_id", F.col("text").alias("content")).distinct()
    return ingest.extracted(c.join(f, "file_id")).groupBy("what", "kind").agg(F.count("*").alias("n"))


def truncated_texts(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return c.select("chunk_id", excerpts.truncate(F.col("text"), F.lit(1000)).alias("excerpt"))


QUERIES = {
    f.__name__: f for f in (
        table_counts, ownership_check, fk_orphans, entity_consistency, index_equality, upsert_conflicts, idempotent_rows, order_violations, queued_updates, claim_transition,
        citation_allowlist, broken_citations, session_coalesce, event_islands, event_tail, reference_chunks, ingested, truncated_texts)
}

from spindrift.plans.changes import _ORDER  # noqa: E402

_FK = """WITH k AS (SELECT DISTINCT generation_id, file_id FROM files WHERE n_bytes IS NOT NULL)
  SELECT 'files.generation' AS check_name, generation_id AS key FROM (SELECT DISTINCT generation_id FROM files WHERE generation_id IS NOT NULL EXCEPT SELECT generation_id FROM generations WHERE status = 'sealed')
  UNION ALL SELECT 'files.generation', generation_id FROM (SELECT DISTINCT generation_id FROM files WHERE generation_id IS NOT NULL AND n_bytes IS NOT NULL EXCEPT SELECT generation_id FROM generations)
  UNION ALL SELECT 'symbols.file', generation_id || '/' || file_id FROM (SELECT DISTINCT generation_id, file_id FROM symbols EXCEPT SELECT * FROM k)
  UNION ALL SELECT 'chunks.file', generation_id || '/' || file_id FROM (SELECT DISTINCT generation_id, file_id FROM chunks EXCEPT SELECT * FROM k)
  UNION ALL SELECT 'edges.source', generation_id || '/' || source_id FROM (SELECT DISTINCT generation_id, source_id FROM edges EXCEPT SELECT * FROM k)"""

SQL = {
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES),
    "ownership_check": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE status = 'sealed') AS n_owned FROM generations",
    "fk_orphans": _FK,
    "entity_consistency": """WITH n AS (SELECT DISTINCT generation_id, target AS id, regexp_extract(target, '^([a-z]+)_', 1) AS kind FROM edges WHERE target IS NOT NULL AND NOT coalesce(target_is_external, true)),
      r AS (SELECT DISTINCT generation_id, file_id AS id, 'file' AS kind FROM files UNION SELECT DISTINCT generation_id, symbol_id, 'symbol' FROM symbols UNION SELECT DISTINCT generation_id, chunk_id, 'chunk' FROM chunks)
      SELECT violation, count(*) AS n FROM (
        SELECT kind || ' entity without row' AS violation FROM (SELECT * FROM n WHERE kind IN ('file', 'symbol', 'chunk') EXCEPT SELECT * FROM r)
        UNION ALL SELECT kind || ' row without entity' FROM (SELECT * FROM r EXCEPT SELECT * FROM n)) GROUP BY 1""",
    "index_equality": """WITH a AS (SELECT DISTINCT entity_id, symbol, start_line, end_line FROM lexical_docs WHERE kind = 'symbol'),
      b AS (SELECT DISTINCT symbol_id AS entity_id, name AS symbol, start_line, end_line FROM symbols)
      SELECT 1 AS surplus, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) HAVING count(*) > 0
      UNION ALL SELECT -1, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) HAVING count(*) > 0""",
    "upsert_conflicts": """SELECT generation_id, file_id, count(DISTINCT (path, coalesce(language, chr(1)), content_digest)) AS n_payloads, count(*) AS n_rows FROM files GROUP BY 1, 2
      HAVING count(DISTINCT (path, coalesce(language, chr(1)), content_digest)) > 1""",
    "idempotent_rows": "SELECT edge_kind, count(*) AS n_rows, sum(source_line) AS lines FROM (SELECT DISTINCT * FROM edges) GROUP BY 1",
    "order_violations": """WITH f AS (SELECT DISTINCT generation_id, path, delivered_at, file_id FROM files),
      l AS (SELECT *, lag(path) OVER (PARTITION BY generation_id ORDER BY delivered_at, file_id, path) AS p FROM f) SELECT generation_id, count(*) AS n FROM l WHERE path <= p GROUP BY 1""",
    "queued_updates": """SELECT note_path, claim_id, queued_at, generation_id, allowed_edit_start, allowed_edit_end, array_to_string(broken_citations, ' ') AS broken FROM (
      SELECT *, row_number() OVER (PARTITION BY note_path, claim_id ORDER BY queued_at DESC, old_claim_snapshot DESC) AS n FROM (SELECT DISTINCT * FROM update_queue)) WHERE n = 1""",
    "claim_transition": f"""WITH {_ORDER},
      k AS (SELECT claim_id, max(json_extract_string(old_claim_snapshot, '$.status')) AS status FROM update_queue GROUP BY 1),
      a AS (SELECT claim_id, generation_id, unnest(changed_evidence_ids) AS id, len(broken_citations) > 0 AS inferred FROM update_queue),
      s AS (SELECT a.claim_id, max(CASE WHEN c.change = 'removed' AND NOT inferred THEN 3 WHEN c.change = 'changed' AND NOT inferred THEN 2 WHEN c.change IN ('changed', 'added') THEN 1 ELSE 0 END) AS v
            FROM a LEFT JOIN c ON c.generation_id = a.generation_id AND c.file_id = a.id GROUP BY 1)
      SELECT k.claim_id, CASE v WHEN 3 THEN 'broken' WHEN 2 THEN 'pending_update' WHEN 1 THEN 'stale' ELSE coalesce(status, 'current') END AS status FROM k LEFT JOIN s USING (claim_id)""",
    "citation_allowlist": """SELECT DISTINCT generation_id, f.repository_id AS repo, f.path, s.name AS symbol FROM symbols s JOIN files f USING (generation_id, file_id)""",
    "broken_citations": """WITH q AS (SELECT DISTINCT note_path, claim_id, unnest(broken_citations) AS text FROM update_queue),
      x AS (SELECT *, unnest(regexp_extract_all(text, '`([^`]*)`', 1)) AS y FROM q)
      SELECT note_path, claim_id, text, regexp_extract(y, '^([^@:]+)@[^:]*:([^#]+)#([^:]+):.*$', 1) AS repo, regexp_extract(y, '^([^@:]+)@[^:]*:([^#]+)#([^:]+):.*$', 2) AS path,
        regexp_extract(y, '^([^@:]+)@[^:]*:([^#]+)#([^:]+):.*$', 3) AS symbol FROM x WHERE regexp_matches(y, '^([^@:]+)@[^:]*:([^#]+)#([^:]+):.*$')""",
    "session_coalesce": """WITH e AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT user_id::VARCHAR AS source, min(ts) AS started, array_to_string(list_sort(list_distinct(list('src/' || event_type))), ' ') AS paths, false AS full_scan, count(*) AS n_events FROM g GROUP BY user_id, k""",
    "event_islands": """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events),
      g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, k AS island, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM g GROUP BY 1, 2""",
    "event_tail": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
}
