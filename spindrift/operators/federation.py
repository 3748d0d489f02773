"""Results of several repositories in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What the score of a packet's item is taken from.
ITEMS = "items array<struct<score_explanations: array<struct<score: double>>>>"


def item_score(items: DataFrame) -> DataFrame:
    """Score of an item across repositories: the sum of its explanations."""
    return items.withColumn("score", F.aggregate("explanations", F.lit(0.0), lambda a, x: a + x["score"]))


def federated(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Merged rank of each query's items: score, repository, local rank.

    ``results``: query_id, repository, local_rank, score. NaN counts as the
    greatest score, null as the least.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "repository", "local_rank")
    out = results.withColumn("merged_rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("merged_rank") <= limit)


def with_places(packets: DataFrame) -> DataFrame:
    """Packets of many repositories, each with the places of its items in the merged order.

    ``packets``: query_id, repository, packet; one for each pair. The result has
    ``merged_ranks`` besides, in the order of the packet's items.
    """
    items = packets.select("query_id", "repository", F.posexplode(F.from_json("packet", ITEMS)["items"]["score_explanations"]).alias("local_rank", "explanations"))
    merged = federated(item_score(items).select("query_id", "repository", "local_rank", "score"))
    places = merged.groupBy("query_id", "repository").agg(F.array_sort(F.collect_list(F.struct("local_rank", "merged_rank"))).alias("p"))
    none = F.array().cast("array<int>")
    return packets.join(places, ["query_id", "repository"], "left").withColumn("merged_ranks", F.coalesce(F.col("p.merged_rank"), none)).drop("p")


def unresolved_members(members: DataFrame, registry: DataFrame) -> DataFrame:
    """Members of a workspace that no registered checkout stands for."""
    return members.select("repository").distinct().join(registry.select("repository").distinct(), "repository", "left_anti")
