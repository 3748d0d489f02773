"""Weighted reciprocal-rank fusion of candidate pools.

With a ``scope`` every query is ranked in each value of those columns apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import score_text

#: Pools in their order with their weights, and the constant of RRF.
POOL_WEIGHTS = {"lexical": 1.0, "exact_path": 2.0, "exact_symbol": 2.0, "exact_identifier": 1.5, "exact_metadata": 1.5, "graph": 0.75, "vectors": 1.0}
POOL_ORDER = {name: i for i, name in enumerate(POOL_WEIGHTS)}
RANK_OFFSET = 60
MAX_CANDIDATES = 256
DECIMALS = 9


def pool(name: str, hits: DataFrame, order: list, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, scope, pool, entity_id, rank): the first place of each entity, from 1."""
    key = ["query_id", *scope]
    first = hits.withColumn("p", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    first = first.groupBy(*key, "entity_id").agg(F.min("p").alias("p"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("p"))
    return first.select(*key, F.lit(name).alias("pool"), "entity_id", rank.alias("rank"))


def pools_union(*pools: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, pools)


def _weights(col: str = "pool"):
    return F.create_map(*[F.lit(x) for kv in POOL_WEIGHTS.items() for x in kv])[F.col(col)]


def candidate_counts(pools: DataFrame, omitted: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """Distinct candidates of each query, those omitted before included."""
    key = ["query_id", *scope]
    every = pools.select(*key, "entity_id")
    if omitted is not None:
        every = every.unionByName(omitted.select(*key, "entity_id"))
    return every.groupBy(*key).agg(F.countDistinct("entity_id").alias("n_candidates"))


def bounded(pools: DataFrame, most: int = MAX_CANDIDATES, on_overflow: str = "error", scope: tuple[str, ...] = ()) -> DataFrame:
    """Pools of queries with at most ``most`` distinct candidates.

    ``error`` fails the query plan, as one overfull query is an error;
    ``truncate`` keeps the ``most`` candidates with the best fused score.
    """
    if on_overflow == "truncate":
        kept = fuse(pools, scope=scope).filter(F.col("rank") <= most).select("query_id", *scope, "entity_id")
        return pools.join(kept, ["query_id", *scope, "entity_id"], "left_semi")
    counts = candidate_counts(pools, scope=scope)
    ok = counts.filter(F.when(F.col("n_candidates") > most, F.raise_error(F.concat(F.lit("too many candidates for query "), F.col("query_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    return pools.join(ok.select("query_id", *scope), ["query_id", *scope])


def fuse(pools: DataFrame, docs: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """Fused score and rank of every candidate.

    Result: query_id, scope, entity_id, score, rank, explanations (array of
    pool, weight share, text, in pool order). A pool counts with its share of the
    weights of the pools that are not empty for the query. Equal scores are
    ordered by path and symbol (null first), if ``docs`` are given, and by id.
    """
    key = ["query_id", *scope]
    w = pools.withColumn("w", _weights())
    active = w.select(*key, "pool", "w").distinct().groupBy(*key).agg(F.sum("w").alias("total")).filter("total > 1e-7")
    part = w.join(active, key).withColumn("share", F.col("w") / F.col("total"))
    order = F.create_map(*[F.lit(x) for kv in POOL_ORDER.items() for x in kv])[F.col("pool")]
    fused = part.groupBy(*key, "entity_id").agg(
        F.round(F.sum(F.col("share") / (RANK_OFFSET + F.col("rank"))), DECIMALS).alias("score"),
        F.array_sort(F.collect_list(F.struct(order.alias("order"), F.col("pool").alias("scorer"), F.col("share").alias("score"), score_text(F.col("share"), F.col("rank")).alias("explanation")))).alias("explanations"))
    if docs is None:
        order_by = [F.desc("score"), F.asc("entity_id")]
    else:
        fused = fused.join(docs.select(*scope, "entity_id", "path", "symbol"), [*scope, "entity_id"], "left")
        order_by = [F.desc("score"), F.asc_nulls_first("path"), F.asc_nulls_first("symbol"), F.asc("entity_id")]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order_by))).select(
        *key, "entity_id", "score", "rank",
        F.transform("explanations", lambda x: F.struct(x["scorer"].alias("scorer"), x["score"].alias("score"), x["explanation"].alias("explanation"))).alias("explanations"))
