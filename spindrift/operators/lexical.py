"""Inverted index over documents and BM25 ranking of batches of queries.

A document has entity_id, repository, revision, path, language, symbol, body,
start_line, end_line, kind. Queries are data: each operator takes a frame with
query_id and query and answers all of them in one plan. Where an operator takes
a ``scope``, each value of those columns is a collection of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import query_terms, tokens
from spindrift.tables import is_small, one_row

#: Parameters of BM25, and results of one source.
K1, B = 1.2, 0.75
SOURCE_LIMIT = 257
#: Decimals to which scores are compared, so that engines agree on ties.
DECIMALS = 6


def distinct_documents(docs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One document per entity_id; of different rows with an id the least counts."""
    return one_row(docs.filter("entity_id IS NOT NULL"), *scope, "entity_id")


def postings(docs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, term, entity_id, path, kind, tf, n_terms) of distinct documents; a null body has no terms."""
    t = docs.select(*scope, "entity_id", "path", "kind", tokens(F.coalesce("body", F.lit(""))).alias("t"))
    words = t.select(*scope, "entity_id", "path", "kind", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    return words.groupBy(*scope, "entity_id", "path", "kind", "n_terms", "term").agg(F.count("*").alias("tf"))


def stored_index(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of an inverted index to be written: postings in the order of terms, and collection statistics.

    Files and row groups then cover ranges of terms, so that a search reads
    those of its terms only.
    """
    d = distinct_documents(docs)
    return {"postings": postings(d).repartitionByRange("term").sortWithinPartitions("term"), "lexical_stats": collection_stats(d)}


def collection_stats(docs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row for each collection: number of documents and their average length."""
    n = F.size(tokens(F.coalesce("body", F.lit(""))))
    return docs.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_terms"))


def token_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Frequency of each term in documents (df) and in all (cf); ``key`` is unique."""
    per_doc = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, queries: DataFrame, limit: int = SOURCE_LIMIT, scope: tuple[str, ...] = (), index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best documents of each query by BM25 over any of its terms.

    Result: query_id, scope, entity_id, score, rank (from 1). Equal scores are ordered
    by path, kind and id, null paths first. Query terms reach the postings
    before any shuffle: only matching terms are counted. With ``index``, the
    :func:`postings` and :func:`collection_stats` of the same documents, no text
    is read.
    """
    terms = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    # Neither the wanted terms nor their frequencies outnumber the query terms.
    near = F.broadcast if is_small(terms) else lambda df: df
    wanted = near(terms.select("term").distinct())
    if index:
        hits, stats = index[0].join(wanted, "term"), index[1]
    else:
        d = docs.select(*scope, "entity_id", "path", "kind", tokens(F.coalesce("body", F.lit(""))).alias("t"))
        hits = (
            d.select(*scope, "entity_id", "path", "kind", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
            .join(wanted, "term")
            .groupBy(*scope, "entity_id", "path", "kind", "n_terms", "term").agg(F.count("*").alias("tf"))
        )
        stats = collection_stats(docs, scope)
    if scope:  # of many collections there may be too many rows to broadcast
        counted = hits.withColumn("df", F.count("*").over(Window.partitionBy(*scope, "term"))).join(stats, list(scope))
    else:  # a single row
        counted = hits.join(near(hits.groupBy("term").agg(F.count("*").alias("df"))), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("avg_terms")))
    scored = (
        counted.join(near(terms), "term")
        .groupBy("query_id", *scope, "entity_id", "path", "kind").agg(F.round(F.sum(part), DECIMALS).alias("score"))
    )
    best = Window.partitionBy("query_id", *scope).orderBy(F.desc("score"), F.asc_nulls_first("path"), "kind", "entity_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", *scope, "entity_id", "score", "rank")
