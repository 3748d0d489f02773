"""Queries on vectors, with SQL where it can state the same result."""

from __future__ import annotations

from spindrift.llm import neighbours
from spindrift.tables import table

#: The stated query set of a search: every row whose id is divisible by 50.
QUERY_SET = "ordinal % 50 = 0"


def p4_found(spark, d):
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "vectors"), k=10, least=0.9))


def p4_search(spark, d):
    """Ten most similar entities of each query; recall is in p4_lost."""
    return neighbours.nearest(table(spark, d, "vectors"), k=10, queries=QUERY_SET, tables=26, functions=2, probes=48)


def p4_lost(spark, d):
    """How many true neighbours p4_search loses, against all buckets probed."""
    exact = neighbours.nearest(table(spark, d, "vectors"), k=10, queries=QUERY_SET, tables=1, probes=1 << 30)
    return neighbours.lost_neighbours(p4_search(spark, d), exact)


QUERIES = {"p4_found": p4_found, "p4_search": p4_search, "p4_lost": p4_lost}

SQL = {
    "p4_found": """WITH v AS (SELECT entity_id, dimension, min(embedding)::DOUBLE[] AS e FROM vectors
        WHERE embedding IS NOT NULL AND len(embedding) = dimension AND len(list_filter(embedding, lambda x: isfinite(x))) = dimension
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
      p AS (SELECT a.entity_id AS a, b.entity_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b
            ON a.dimension = b.dimension AND a.entity_id <> b.entity_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM p WHERE c >= 0.9)
      SELECT DISTINCT least(a, b) AS entity_a, greatest(a, b) AS entity_b FROM r WHERE n <= 10""",
}
