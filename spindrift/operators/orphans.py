"""References to records that do not exist.

Parent keys and child keys are brought into one long form, tagged, and grouped
by a 128-bit hash of repository and key. The partial aggregation runs before the
shuffle, so a target that holds a tenth of all references leaves each task as
one row. Groups in which a child names a generation that has no parent are
orphans. Edges are reduced to those of orphan keys where they are read; if these
keys are too many to broadcast, the join is salted, so that a hot target spreads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.tables import BROADCAST_ROWS, broadcast_if_small, cut, is_small

#: Prefixes of ids inside the graph.
ID_PREFIXES = ("file_", "symbol_", "chunk_")
#: Parts over which the edges of one orphan key spread in a join that is not broadcast.
SALTS = 16


def generation_numbers(generations: DataFrame) -> DataFrame:
    """Every generation with repository, number ``gno`` and whether it is sealed.

    ``gno`` orders a repository's generations by sealed_at (started_at where it
    is null), then by id.
    """
    one = (
        generations.filter("generation_id IS NOT NULL")
        .groupBy("generation_id")
        .agg(F.max(F.struct(
            (F.col("status").eqNullSafe("sealed") & F.col("sealed_at").isNotNull()).alias("sealed"),
            F.coalesce("sealed_at", "started_at").alias("t"), "repository_id")).alias("g"))
        .select("generation_id", "g.*")
    )
    w = Window.partitionBy("repository_id").orderBy("t", "generation_id")
    return one.select("generation_id", "repository_id", F.row_number().over(w).cast("int").alias("gno"), "sealed")


def _located(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """(generation_id, key, ...) to (k1, k2, gno, sealed, ...); unknown generations stand alone."""
    repo = F.coalesce("repository_id", F.concat(F.lit("?"), F.col("generation_id")))
    return df.join(numbers, "generation_id", "left").select(
        F.xxhash64(repo, "key").alias("k1"), F.xxhash64("key", F.lit(7), repo).alias("k2"),
        F.coalesce("gno", F.lit(0)).alias("gno"), F.coalesce("sealed", F.lit(False)).alias("sealed"), *[c for c in df.columns if c not in ("generation_id", "key")])


def inside_edges(edges: DataFrame) -> DataFrame:
    """Edges that point, or by their look point, at something in the graph."""
    looks_inside = F.lit(False)
    for p in ID_PREFIXES:
        looks_inside = looks_inside | F.col("target").startswith(p)
    return edges.filter(
        F.col("target").isNotNull() & F.col("generation_id").isNotNull()
        & ((F.col("target_is_external") == F.lit(False)) | (F.col("target_is_external").isNull() & looks_inside)))


def edge_orphan_keys(edges: DataFrame, parents: list[tuple[DataFrame, str]], generations: DataFrame) -> DataFrame:
    """(k1, k2, gno, reason) of targets that their generation lacks."""
    numbers = broadcast_if_small(generation_numbers(generations))
    parent = None
    for df, col in parents:
        keys = df.select("generation_id", F.col(col).alias("key"))
        parent = keys if parent is None else parent.unionByName(keys)
    parent = _located(parent.filter("key IS NOT NULL AND generation_id IS NOT NULL"), numbers).withColumn("child", F.lit(False))
    child = _located(inside_edges(edges).select("generation_id", F.col("target").alias("key")), numbers).withColumn("child", F.lit(True))
    groups = (
        parent.unionByName(child)
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.when(~F.col("child"), F.col("gno"))).alias("has"),
             F.collect_set(F.when(F.col("child"), F.col("gno"))).alias("asked"),
             F.min(F.when(~F.col("child") & F.col("sealed"), F.col("gno"))).alias("first_sealed"),
             F.max(F.when(~F.col("child") & F.col("sealed"), F.col("gno"))).alias("last_sealed"))
        .withColumn("lacking", F.array_except("asked", "has"))
        .filter(F.size("lacking") > 0)
    )
    return groups.select("k1", "k2", F.explode("lacking").alias("gno"), "first_sealed", "last_sealed").select(
        "k1", "k2", "gno",
        F.when(F.col("first_sealed") < F.col("gno"), "deleted")
        .when(F.col("last_sealed") > F.col("gno"), "late").otherwise("missing").alias("reason"))


def orphan_edges(edges: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame, generations: DataFrame) -> DataFrame:
    """Edges whose inner target does not exist in their generation.

    Result: edge_id, target, reason (``deleted``: an earlier sealed generation
    of the repository has it; else ``late``: a later one has it; else
    ``missing``), observed_at. Arrival times do not matter. Null targets, flags
    that say external and rows without a generation take no part; an empty
    target is a target. Repeated rows give repeated results.
    """
    keys = edge_orphan_keys(edges, [(files, "file_id"), (symbols, "symbol_id"), (chunks, "chunk_id")], generations)
    keys = cut(keys)
    numbers = broadcast_if_small(generation_numbers(generations))
    rows = _located(inside_edges(edges).select("edge_id", "generation_id", F.col("target").alias("key"), "target", "observed_at"), numbers).drop("sealed")
    if is_small(keys, BROADCAST_ROWS):
        found = rows.join(F.broadcast(keys), ["k1", "k2", "gno"])
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.lit(SALTS)))
        found = salted.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["k1", "k2", "gno", "salt"])
    return found.select("edge_id", "target", "reason", "observed_at")


def orphan_externals(extractions: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """Unresolved external symbols that no table knows.

    Result: extraction_id, target, reason ``missing``, imported_at. Elements
    compare exactly; those beginning with ``local `` and nulls take no part;
    repeated elements of one extraction count once.
    """
    child = (
        extractions.select("extraction_id", "imported_at", F.explode(F.array_distinct("unresolved_external_symbols")).alias("target"))
        .filter(F.col("target").isNotNull() & ~F.col("target").startswith("local "))
    )
    lacking = (
        symbols.select(F.col("scip_symbol").alias("target")).unionByName(packages.select(F.col("scip_symbol").alias("target")))
        .withColumn("known", F.lit(True))
        .unionByName(child.select("target").withColumn("known", F.lit(False)))
        .filter("target IS NOT NULL")
        .groupBy("target").agg(F.max("known").alias("known")).filter("NOT known").select("target")
    )
    return child.join(lacking, "target").select("extraction_id", "target", F.lit("missing").alias("reason"), "imported_at")


def orphan_references(edges, files, symbols, chunks, generations, extractions, packages) -> DataFrame:
    """All orphans: source_table, source_key, target, reason, seen_at."""
    e = orphan_edges(edges, files, symbols, chunks, generations)
    x = orphan_externals(extractions, symbols, packages)
    return e.select(F.lit("edges").alias("source_table"), F.col("edge_id").alias("source_key"), "target", "reason", F.col("observed_at").alias("seen_at")).unionByName(
        x.select(F.lit("scip_extractions").alias("source_table"), F.col("extraction_id").alias("source_key"), "target", "reason", F.col("imported_at").alias("seen_at")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct orphans per table, month and reason; a null time has month null."""
    return (
        orphans.distinct()
        .groupBy("source_table", F.date_format("seen_at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count("*").alias("n_orphans"))
    )
