"""Neighbours in the evidence graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inner_edges(edges: DataFrame) -> DataFrame:
    """Distinct (generation_id, a, b) in both directions, without external targets."""
    e = edges.filter(F.col("target").isNotNull() & ~F.coalesce("target_is_external", F.lit(False))).select("generation_id", "source_id", "target")
    return e.select("generation_id", F.col("source_id").alias("a"), F.col("target").alias("b")).unionByName(
        e.select("generation_id", F.col("target").alias("a"), F.col("source_id").alias("b"))).filter("a <> b").distinct()


def structural_edges(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that follow from containment: file to chunk and file to symbol."""
    return chunks.select("generation_id", F.lit("contains").alias("edge_kind"), F.col("file_id").alias("source_id"), F.col("chunk_id").alias("target"),
                         F.lit(False).alias("target_is_external"), F.col("start_line").alias("source_line")).unionByName(
        symbols.select("generation_id", F.lit("defines").alias("edge_kind"), F.col("file_id").alias("source_id"), F.col("symbol_id").alias("target"),
                       F.lit(False).alias("target_is_external"), F.col("start_line").alias("source_line"))).distinct()


def neighbours(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """One step from (query_id, generation_id, node), distinct."""
    return frontier.join(links.withColumnRenamed("a", "node"), ["generation_id", "node"]).select("query_id", "generation_id", F.col("b").alias("node")).distinct()


def within_hops(seeds: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` steps of the seeds of each query, without the seeds.

    ``seeds``: query_id, generation_id, node. Every step joins only the nodes
    that are new, so a hub is expanded once for a query.
    """
    key = ["query_id", "generation_id", "node"]
    levels = [seeds.select(*key).filter("node IS NOT NULL").distinct()]
    for _ in range(hops):
        seen = reduce(DataFrame.unionByName, levels)
        levels.append(neighbours(levels[-1], links).join(seen, key, "left_anti"))
    return reduce(DataFrame.unionByName, levels[1:]).withColumnRenamed("node", "entity_id")
