"""Exact lookups: paths, symbols, identifiers, names in the graph, edges.

Pools keep the columns of ``scope``, so that a hit stays in its collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import exact_terms, identifier_terms, path_terms, tokens
from spindrift.tables import broadcast_if_small


def by_path(docs: DataFrame, path: str) -> DataFrame:
    return docs.filter(F.col("path") == path)


def by_symbol(docs: DataFrame, symbol: str) -> DataFrame:
    return docs.filter(F.col("symbol") == symbol)


def by_identifier(docs: DataFrame, identifier: str) -> DataFrame:
    """Documents whose body has the one term that the identifier is; else none."""
    t = tokens(F.lit(identifier))
    return docs.filter((F.size(t) == 1) & F.array_contains(tokens(F.col("body")), F.get(t, F.lit(0))))


def _matched(queries: DataFrame, terms: Column, docs: DataFrame, key: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    t = broadcast_if_small(queries.select("query_id", F.explode(terms).alias("term")).distinct())
    return docs.withColumn("term", key).join(t, "term").select("query_id", *scope, "entity_id").distinct()


def path_pool(docs: DataFrame, queries: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return _matched(queries, path_terms(F.col("query")), docs, F.col("path"), scope)


def symbol_pool(docs: DataFrame, queries: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return _matched(queries, exact_terms(F.col("query")), docs, F.col("symbol"), scope)


def identifier_pool(docs: DataFrame, queries: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Documents that contain an identifier-like term which is a single word."""
    t = queries.select("query_id", F.explode(identifier_terms(F.col("query"))).alias("raw")).select("query_id", tokens(F.col("raw")).alias("t"))
    t = broadcast_if_small(t.filter(F.size("t") == 1).select("query_id", F.get("t", F.lit(0)).alias("term")).distinct())
    words = docs.select(*scope, "entity_id", F.explode(F.array_distinct(tokens(F.coalesce("body", F.lit(""))))).alias("term"))
    return words.join(t, "term").select("query_id", *scope, "entity_id").distinct()


def graph_names(files: DataFrame, symbols: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Files by path and symbols by name, as (scope, name, entity_id, ordering)."""
    return files.select(*scope, F.col("path").alias("name"), F.col("file_id").alias("entity_id"), F.lit(0).alias("ordering")).unionByName(
        symbols.select(*scope, "name", F.col("symbol_id").alias("entity_id"), F.lit(1).alias("ordering")))


def by_name(files: DataFrame, symbols: DataFrame, name: str, limit: int = 257) -> DataFrame:
    """Files first, then symbols, with exactly this path or name."""
    return graph_names(files, symbols).filter(F.col("name") == name).distinct().orderBy("ordering", "entity_id").limit(limit).select("entity_id", "ordering")


def metadata_pool(files: DataFrame, symbols: DataFrame, queries: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return _matched(queries, exact_terms(F.col("query")), graph_names(files, symbols, scope), F.col("name"), scope)


def by_edge_kind(edges: DataFrame, kind: str, limit: int = 10_000) -> DataFrame:
    """Edges of a kind in the order of source, line and target."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be 1 to 10000")
    return edges.filter(F.col("edge_kind") == kind).orderBy("source_id", "source_line", F.asc_nulls_first("target"), "edge_id").limit(limit)


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.filter(F.col("key") == key).select("value")
