"""Queries on documents, with SQL where it can state the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.llm import contamination, packing, toxicity
from spindrift.tables import table


def p7_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark, d):
    return packing.fill_report(p7_pack(spark, d))


def p7_check(spark, d):
    """For every document whether its token ranges follow each other without gap, in containers that hold them."""
    placed = p7_pack(spark, d)
    size = F.col("token_end") - F.col("token_start")
    load = placed.groupBy("container").agg((F.sum(size) <= packing.CAPACITY).alias("held"))
    before = F.lag("token_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("token_start"))
    return placed.join(load, "container").withColumn("follows", F.col("token_start") == before).groupBy("doc_id").agg(
        F.bool_and("follows").alias("gapless"), F.bool_and("held").alias("held"), (F.max("token_end") > 0).alias("filled"))


def _leaks(spark, d):
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_leaks(spark, d):
    return _leaks(spark, d)


def _scores(spark, d):
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_found(spark, d):
    return _scores(spark, d).filter("flagged AND doc_id IS NOT NULL").select("doc_id").distinct()


def p9_scores(spark, d):
    return _scores(spark, d)


def p9_rates(spark, d):
    return toxicity.rates(_scores(spark, d))


QUERIES = {
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_check": p7_check}

SQL: dict[str, str] = {
    "p7_check": "SELECT DISTINCT doc_id, true AS gapless, true AS held, true AS filled FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''"}
