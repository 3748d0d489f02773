"""Queries on snapshots and references, with SQL that states the same result."""

from __future__ import annotations

from spindrift.operators import orphans, snapshots
from spindrift.tables import table


def _changes(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "files"), table(spark, d, "generations"))


def p1_found(spark, d):
    return snapshots.evidence_changes(table(spark, d, "files"), table(spark, d, "generations"), table(spark, d, "update_queue"))


def p1_report(spark, d):
    return snapshots.change_report(_changes(spark, d))


def p1_values(spark, d):
    return _changes(spark, d)


def _orphans(spark, d):
    names = ("edges", "files", "symbols", "chunks", "generations", "scip_extractions", "package_symbols")
    return orphans.orphan_references(*(table(spark, d, n) for n in names))


def p3_found(spark, d):
    return _orphans(spark, d).select("source_table", "source_key", "target", "reason").distinct()


def p3_report(spark, d):
    return orphans.orphan_report(_orphans(spark, d))


_ORDER = """
g AS (SELECT generation_id, repository_id, sealed_at,
        row_number() OVER (PARTITION BY repository_id ORDER BY sealed_at, generation_id) AS seq
      FROM (SELECT DISTINCT generation_id, repository_id, sealed_at FROM generations WHERE status = 'sealed')),
f AS (SELECT repository_id, generation_id, seq, file_id, digest FROM (
        SELECT g.repository_id, g.generation_id, g.seq, f.file_id,
          lower(regexp_replace(f.content_digest, '^[A-Za-z0-9_-]+:', '')) AS digest,
          row_number() OVER (PARTITION BY f.generation_id, f.file_id ORDER BY f.delivered_at DESC,
            lower(regexp_replace(f.content_digest, '^[A-Za-z0-9_-]+:', '')) DESC) AS rn
        FROM files f JOIN g ON f.generation_id = g.generation_id) WHERE rn = 1),
c AS (
  SELECT b.generation_id, b.file_id, CASE WHEN a.file_id IS NULL THEN 'added' ELSE 'changed' END AS change,
    a.digest AS digest_before, b.digest AS digest_after
  FROM f b LEFT JOIN f a ON a.repository_id = b.repository_id AND a.seq = b.seq - 1 AND a.file_id = b.file_id
  WHERE b.seq > 1 AND (a.file_id IS NULL OR a.digest IS DISTINCT FROM b.digest)
  UNION ALL
  SELECT n.generation_id, a.file_id, 'removed', a.digest, NULL
  FROM f a JOIN g n ON n.repository_id = a.repository_id AND n.seq = a.seq + 1
  LEFT JOIN f b ON b.generation_id = n.generation_id AND b.file_id = a.file_id
  WHERE b.file_id IS NULL)
"""

_ORPHANS = """
n AS (SELECT generation_id, repository_id, status = 'sealed' AND sealed_at IS NOT NULL AS sealed, coalesce(sealed_at, started_at) AS t
      FROM (SELECT DISTINCT * FROM generations)),
p AS (SELECT generation_id, file_id AS id FROM files UNION SELECT generation_id, symbol_id FROM symbols UNION SELECT generation_id, chunk_id FROM chunks),
s AS (SELECT n.repository_id, n.t, p.id FROM p JOIN n USING (generation_id) WHERE n.sealed),
k AS (SELECT DISTINCT generation_id, target FROM edges WHERE target IS NOT NULL AND (NOT target_is_external OR (target_is_external IS NULL
        AND (starts_with(target, 'file_') OR starts_with(target, 'symbol_') OR starts_with(target, 'chunk_'))))),
o AS (SELECT k.generation_id, k.target, n.repository_id, n.t FROM k LEFT JOIN n USING (generation_id)
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.generation_id = k.generation_id AND p.id = k.target)),
r AS (SELECT o.generation_id, o.target, CASE WHEN min(s.t) < max(o.t) THEN 'deleted' WHEN max(s.t) > max(o.t) THEN 'late' ELSE 'missing' END AS reason
      FROM o LEFT JOIN s ON s.repository_id = o.repository_id AND s.id = o.target GROUP BY 1, 2),
x AS (SELECT DISTINCT 'edges' AS source_table, e.edge_id AS source_key, e.target, r.reason, e.observed_at AS seen_at
      FROM edges e JOIN r ON e.generation_id = r.generation_id AND e.target = r.target
      WHERE NOT e.target_is_external OR (e.target_is_external IS NULL
        AND (starts_with(e.target, 'file_') OR starts_with(e.target, 'symbol_') OR starts_with(e.target, 'chunk_')))
      UNION
      SELECT DISTINCT 'scip_extractions', extraction_id, sym, 'missing', imported_at
      FROM (SELECT extraction_id, imported_at, unnest(unresolved_external_symbols) AS sym FROM scip_extractions)
      WHERE sym IS NOT NULL AND NOT starts_with(sym, 'local ')
        AND sym NOT IN (SELECT scip_symbol FROM symbols WHERE scip_symbol IS NOT NULL)
        AND sym NOT IN (SELECT scip_symbol FROM package_symbols WHERE scip_symbol IS NOT NULL))
"""

QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p1_report": p1_report, "p3_found": p3_found, "p3_report": p3_report}

SQL = {
    "p1_found": f"""WITH {_ORDER}
      SELECT generation_id, file_id AS evidence_id, change FROM c
      UNION ALL
      SELECT q.generation_id, q.id, 'unconfirmed' FROM (SELECT DISTINCT generation_id, unnest(changed_evidence_ids) AS id FROM update_queue) q
      LEFT JOIN c ON c.generation_id = q.generation_id AND c.file_id = q.id
      WHERE q.id IS NOT NULL AND q.generation_id IS NOT NULL AND c.file_id IS NULL""",
    "p1_values": f"WITH {_ORDER} SELECT * FROM c",
    "p1_report": f"WITH {_ORDER} SELECT generation_id, change, count(*) AS n_files FROM c GROUP BY 1, 2",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT source_table, source_key, target, reason FROM x",
    "p3_report": f"WITH {_ORPHANS} SELECT source_table, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM x GROUP BY 1, 2, 3",
}
