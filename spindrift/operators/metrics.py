"""Quality of rankings and of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_quality(ranking: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """recall and nDCG at ``k`` of each judged query.

    ``ranking``: query_id, entity_id, rank; ``judgments``: query_id, entity_id,
    gain (integers, 0 for irrelevant). Gains count as 2^gain - 1, discounted by
    log2(rank + 1). A query without relevant entities has null for both.
    """
    gain = F.pow(F.lit(2.0), F.col("gain")) - 1
    hit = ranking.filter(F.col("rank") <= k).join(judgments, ["query_id", "entity_id"])
    got = hit.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.count_if(F.col("gain") > 0).alias("n_found"))
    best = judgments.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("gain"), asc=False), 1, k).alias("g"), F.count_if(F.col("gain") > 0).alias("n_relevant"))
    ideal = F.aggregate(F.transform("g", lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    return best.join(got, "query_id", "left").select(
        "query_id",
        F.when(F.col("n_relevant") > 0, F.coalesce("n_found", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def mean_quality(quality: DataFrame) -> DataFrame:
    return quality.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"), F.count("*").alias("n_queries"))


def citation_precision(citations: DataFrame, supported: DataFrame, keys: list[str]) -> DataFrame:
    """Share of citations that the evidence supports."""
    s = supported.select(*keys).distinct().withColumn("ok", F.lit(1))
    return citations.join(s, keys, "left").agg((F.count("ok") / F.count("*")).alias("precision"), F.count("*").alias("n_citations"))


def median_latency(timings: DataFrame, column: str = "ms") -> DataFrame:
    return timings.agg(F.percentile(column, 0.5).alias("median_ms"))
