"""Exact scan of vectors for a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of dimension and of results.
MOST_DIMENSION, MOST_RESULTS = 4096, 1024
#: Query vectors that one job takes; a larger batch is given in parts.
MOST_QUERIES = 4096
EPSILON = 1e-7


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either norm is next to nothing."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.sqrt(dot(a, a)) <= EPSILON) | (F.sqrt(dot(b, b)) <= EPSILON), F.lit(0.0)).otherwise(dot(a, b) / norms)


def vector_violations(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows that a vector file of this dimension must not hold."""
    bad = (
        F.when(F.col("entity_id").isNull() | (F.octet_length("entity_id") > 512), "bad id")
        .when(F.col("embedding").isNull() | (F.size("embedding") != dimension), "wrong length")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    )
    return vectors.select("entity_id", bad.alias("violation")).filter("violation IS NOT NULL")


def top_k(vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """The ``k`` nearest entities of each query vector by cosine.

    Result: query_id, entity_id, cosine, rank; equal cosines are ordered by id.
    ``vectors``: entity_id, embedding, all of the queries' dimension; rows of
    another length, null or not finite are left out. Each partition keeps its
    ``k`` best before anything is shuffled.
    """
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k must be 1 to {MOST_RESULTS}")
    if not queries or len(queries) > MOST_QUERIES:
        raise ValueError(f"needs 1 to {MOST_QUERIES} queries")
    dim = len(queries[0][1])
    if not 1 <= dim <= MOST_DIMENSION or any(len(v) != dim for _, v in queries):
        raise ValueError("query vectors must have one dimension, at most 4096")
    ids = [q for q, _ in queries]
    q = np.array([v for _, v in queries], np.float64)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, size, out=np.zeros_like(q), where=size > EPSILON)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [e is not None and len(e) == dim for e in f.embedding]
            f = f[keep]
            if not len(f):
                continue
            x = np.stack(f.embedding.to_numpy()).astype(np.float64)
            ok = np.isfinite(x).all(1)
            x, names = x[ok], f.entity_id.to_numpy()[ok]
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            s = np.round(q @ np.divide(x, norm, out=np.zeros_like(x), where=norm > EPSILON).T, 9)
            for i, row in enumerate(s):
                floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                at = np.flatnonzero(row >= floor)
                yield pd.DataFrame({"query_id": ids[i], "entity_id": names[at], "cosine": row[at]})

    hits = vectors.select("entity_id", "embedding").filter("entity_id IS NOT NULL AND embedding IS NOT NULL").mapInPandas(scan, "query_id string, entity_id string, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "entity_id")
    return hits.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Mean of token vectors under a 0/1 mask."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x * m)), zero, lambda a, t: F.zip_with(a, t, lambda p, q: p + q))
    return F.transform(total, lambda x: x / n)


def cls_pooled(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def normalized(v: Column) -> Column:
    n = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)
