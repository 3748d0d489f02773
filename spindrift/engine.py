"""Entry points: index a checkout, search it, read evidence, keep notes.

``search`` takes many requests at once. Until a request's few hundred candidates
are ranked everything is one relational plan; packets are built per request.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import exact_lines, language_with_overrides, query_terms
from spindrift.operators import claims as claim_ops
from spindrift.operators import exact, federation, flat_vectors, fusion, graph, lexical, packet, resolve, validation
from spindrift.sources import checkout, ingest, notes
from spindrift.tables import broadcast_if_small, cut
from spindrift.sources.store import Config, Generations, Traces, replaced, union_all

REQUESTS = (
    "query_id string, query string, budget int, max_results int, f_repository string, f_revision string, f_path_prefix string, f_language string, f_kinds array<string>")


@dataclass
class Request:
    """One search; the filters apply after ranking."""

    query: str
    query_id: str = "q"
    budget: int = packet.BUDGET
    max_results: int = packet.RESULTS
    repository: str | None = None
    revision: str | None = None
    path_prefix: str | None = None
    language: str | None = None
    kinds: list[str] | None = field(default=None)

    def row(self) -> tuple:
        packet.checked_request(self.budget, self.max_results)
        if not self.query.strip():
            raise ValueError("a query has words")
        return (self.query_id, self.query, self.budget, self.max_results, self.repository, self.revision, self.path_prefix, self.language, self.kinds)


def requests_frame(spark: SparkSession, requests: list[Request]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in requests], REQUESTS)


#: Every generation is searched apart, with its own statistics, ranks and bounds.
SCOPE = ("generation_id",)


def candidate_pools(requests: DataFrame, docs: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, vectors: DataFrame | None = None,
                    index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All pools of all requests: query_id, generation_id, pool, entity_id, rank.

    ``docs`` and the graph carry generation_id. ``vectors`` are hits of an
    embedded query: query_id, generation_id, entity_id, cosine. ``index``: see
    :func:`spindrift.operators.lexical.bm25`.
    """
    queries = requests.select("query_id", "query")
    by_id = [F.asc("entity_id")]
    first = [
        fusion.pool("lexical", lexical.bm25(docs, queries, scope=SCOPE, index=index), [F.desc("score"), F.asc("rank")], SCOPE),
        fusion.pool("exact_path", exact.path_pool(docs, queries, SCOPE), by_id, SCOPE),
        fusion.pool("exact_symbol", exact.symbol_pool(docs, queries, SCOPE), by_id, SCOPE),
        fusion.pool("exact_identifier", exact.identifier_pool(docs, queries, SCOPE), by_id, SCOPE),
        fusion.pool("exact_metadata", exact.metadata_pool(files, symbols, queries, SCOPE), by_id, SCOPE),
    ]
    # Few rows a request, read by the seeds, the graph and the fusion.
    found = cut(union_all(first))
    seeds = found.select("query_id", *SCOPE, F.col("entity_id").alias("node")).distinct()
    around = graph.within_hops(seeds, graph.inner_edges(edges))
    pools = [fusion.pool("graph", around, by_id, SCOPE)]
    if vectors is not None:
        pools.append(fusion.pool("vectors", vectors, [F.desc("cosine"), F.asc("entity_id")], SCOPE))
    return found.unionByName(cut(union_all(pools)))


def search_each(requests: DataFrame, generations: DataFrame, docs: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, resolved: DataFrame,
                vectors: DataFrame | None = None, on_overflow: str = "error", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One packet for each request and generation, as :func:`search` gives it for that generation alone.

    ``generations``: the generation_ids to search; all other frames carry
    generation_id and hold rows of these only; ``docs`` are distinct by
    generation and entity; ``resolved`` are the graph's
    :func:`spindrift.operators.resolve.resolved_entities`. Result:
    :data:`spindrift.operators.packet.PACKETS` and generation_id.
    """
    key = [*SCOPE, "entity_id"]
    pools = fusion.bounded(candidate_pools(requests, docs, files, symbols, edges, vectors, index), on_overflow=on_overflow, scope=SCOPE)
    described = resolved.select(*key, *resolve.AGREEING)
    ranked = fusion.fuse(pools, described, SCOPE)
    indexed = docs.select(*key, *resolve.AGREEING)
    # A candidate is described by the index that found it, else by the graph.
    known = indexed.unionByName(described.join(indexed.select(*key), key, "left_anti")).dropDuplicates(key)
    judged = resolve.with_reasons(ranked.join(known, key, "left"), resolved, requests, SCOPE)
    asked = generations.select(*SCOPE).distinct().crossJoin(broadcast_if_small(requests))
    return packet.packets(judged, asked, SCOPE)


def search(requests: DataFrame, docs: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: DataFrame | None = None,
           on_overflow: str = "error", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One packet for each request; see :data:`spindrift.operators.packet.PACKETS`.

    All frames are of one generation, whatever it is called; ``index`` are the
    tables of :func:`spindrift.operators.lexical.stored_index`.
    """

    def one(df: DataFrame) -> DataFrame:
        return df.withColumn("generation_id", F.lit("current"))

    docs, files, symbols, chunks = cut(lexical.distinct_documents(one(docs), SCOPE)), one(files), one(symbols), one(chunks)
    generations = requests.sparkSession.createDataFrame([("current",)], "generation_id string")
    resolved = cut(resolve.resolved_entities(files, symbols, chunks))
    return search_each(requests, generations, docs, files, symbols, one(edges), resolved, None if vectors is None else one(vectors), on_overflow,
                       index and (one(index[0]), one(index[1]))).drop("generation_id")


class Engine:
    """One repository: its generations, traces and notes."""

    def __init__(self, spark: SparkSession, state: str, note_name: str = notes.NAME):
        self.spark, self.note_name = spark, note_name
        self.generations, self.traces_ = Generations(f"{state}/generations"), Traces(f"{state}/traces.jsonl")

    def index(self, root: str, config: Config, revision: str) -> str:
        """Scan a checkout and make it the current generation; gives its id."""
        from spindrift.functions.ids import new_ulid

        generation_id = f"gen_{new_ulid()}"
        scanned = checkout.scan(self.spark, root, config.repository_id, revision, list(config.include), list(config.exclude))
        rows = checkout.snapshot_rows(scanned, generation_id).withColumn("language", language_with_overrides(F.col("path"), [(checkout.glob_pattern(g), n) for g, n in config.language_overrides]))
        with_text = rows.join(scanned.select("path", "content"), "path")
        tables = ingest.graph_tables(rows, cut(ingest.extracted(with_text)))  # parsed once for all tables
        tables["diagnostics"] = tables["diagnostics"].unionByName(ingest.snapshot_diagnostics(scanned, generation_id)).distinct()
        tables["files"] = rows
        tables["lexical_docs"] = ingest.lexical_documents(with_text, tables["chunks"], tables["symbols"])
        tables |= lexical.stored_index(tables["lexical_docs"])
        tables["texts"] = with_text.select("path", "revision", F.col("repository_id").alias("repository"), "content")
        generation = self.spark.createDataFrame([(generation_id,)], "generation_id string")
        violations = validation.foreign_keys(generation, rows, tables["symbols"], tables["chunks"], tables["edges"])
        return self.generations.write(tables, violations, generation_id)

    rebuild = index

    def table(self, name: str) -> DataFrame:
        return self.generations.read(self.spark, name)

    def index_of(self, requests: tuple[Request, ...]) -> tuple[DataFrame, DataFrame]:
        """Stored postings of the requests' terms, which the reader finds by their order, and the statistics."""
        asked = requests_frame(self.spark, list(requests)).select(F.explode(query_terms(F.col("query"))).alias("term")).distinct().collect()
        return self.table("postings").filter(F.col("term").isin([r.term for r in asked])), self.table("lexical_stats")

    def search(self, *requests: Request, vectors: DataFrame | None = None, on_overflow: str = "error", trace: bool = True) -> list[dict]:
        """Packets of the requests, in their order, each with what was left out."""
        t = {n: self.table(n) for n in ("lexical_docs", "files", "symbols", "chunks", "edges")}
        found = search(requests_frame(self.spark, list(requests)), t["lexical_docs"], t["files"], t["symbols"], t["chunks"], t["edges"], vectors, on_overflow, self.index_of(requests))
        by_id = {r.query_id: r.asDict(recursive=True) for r in found.collect()}
        out = [by_id[r.query_id] for r in requests]
        if trace:
            for p in out:
                self.traces_.append({"generation_id": self.generations.current(), "selected": p["selected"], "omitted": p["omitted"]})
        return out

    def search_vectors(self, vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int = 256) -> DataFrame:
        return flat_vectors.top_k(vectors, queries, k).select("query_id", "entity_id", "cosine")

    def read(self, path: str, first: int, last: int, revision: str) -> str:
        """Exact lines of the current generation; stale if its revision is another."""
        rows = self.table("texts").filter(F.col("path") == path).select("revision", exact_lines(F.col("content"), F.lit(first), F.lit(last)).alias("lines")).collect()
        if not rows or rows[0].lines is None:
            raise LookupError("evidence unavailable")
        if rows[0].revision != revision:
            raise LookupError("evidence stale")
        return rows[0].lines

    def traces(self, limit: int) -> DataFrame:
        return self.traces_.tail(self.spark, limit)

    def health(self) -> dict:
        names = ("files", "symbols", "chunks", "edges", "diagnostics", "lexical_docs")
        t = {n: self.table(n) for n in names}
        generation_id = self.generations.current()
        generation = self.spark.createDataFrame([(generation_id,)], "generation_id string")
        violations = validation.foreign_keys(generation, t["files"], t["symbols"], t["chunks"], t["edges"])
        return validation.health(generation_id, validation.table_counts(**t), violations).collect()[0].asDict(recursive=True)

    def claims(self, folder: str, status: str | None = None) -> DataFrame:
        return claim_ops.claims_with_status(notes.claims_of(notes.read_notes(self.spark, folder), self.note_name).filter("error IS NULL"), status)

    def updates(self, queue: DataFrame) -> DataFrame:
        return claim_ops.queued_updates(queue)

    def apply_update(self, note_path: str, claim_id: str, body: str, queue: DataFrame, current: DataFrame, status: str | None = None, review: str | None = None) -> DataFrame:
        """Apply a queued update to a note; gives the queue without it.

        Rejected with ValueError, note and queue unchanged, for any reason of
        :func:`spindrift.operators.claims.judged_patches`.
        """
        with open(note_path, "rb") as f:
            note = notes.parse_note(f.read(), self.note_name)
        place = [(note_path, k, *c.region) for k, c in note.claims.items()]
        here = self.spark.createDataFrame(place, "note_path string, claim_id string, region_start int, region_end int")
        patch = self.spark.createDataFrame([(note_path, claim_id, body)], "note_path string, claim_id string, body string")
        allowed = claim_ops.allowed_citations(self.table("files"), self.table("symbols"))
        reason = claim_ops.judged_patches(patch, queue, here, allowed, current).collect()[0].reject_reason
        if reason:
            raise ValueError(reason)
        new = note.with_patch(claim_id, body, status, review)
        replaced(note_path, new)
        return queue.filter(~((F.col("note_path") == note_path) & (F.col("claim_id") == claim_id)))


class Workspace:
    """Several engines searched as one."""

    def __init__(self, engines: dict[str, Engine], members: list[str]):
        self.engines, self.members = engines, sorted(set(members))

    def search(self, request: Request, limit: int | None = None) -> tuple[list[dict], list[str]]:
        """Merged items, and members without an engine here."""
        import json

        rows = []
        for name in self.members:
            if name not in self.engines:
                continue
            p = json.loads(self.engines[name].search(request)[0]["packet"])
            rows += [(request.query_id, name, i, sum(float(x["score"]) for x in item["score_explanations"]), json.dumps(item)) for i, item in enumerate(p["items"])]
        missing = [m for m in self.members if m not in self.engines]
        if not rows:
            return [], missing
        spark = next(iter(self.engines.values())).spark
        merged = federation.federated(spark.createDataFrame(rows, "query_id string, repository string, local_rank int, score double, item string"), limit)
        return [json.loads(r.item) | {"repository": r.repository} for r in merged.orderBy("merged_rank").collect()], missing
