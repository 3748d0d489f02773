"""Queries on retrieval, with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift import engine
from spindrift.functions import text as text_fn
from spindrift.functions.ids import framed_id
from spindrift.operators import contradiction, exact, federation, flat_vectors, fusion, graph, lexical, metrics, packet, resolve
from spindrift.operators.snapshots import sealed_order
from spindrift.tables import broadcast_if_small, cut, table

#: A batch of searches, as (query_id, query).
QUERIES_ASKED = (
    ("q1", "sealed cache must not drop the error"), ("q2", "encode_session"), ("q3", "notes/explicit-bucket-4.md"), ("q4", "route_manifest server/graph decode"),
    ("q5", "why does the queue keep its prefix"), ("q6", "skipInterval: number"), ("q7", "the release branch and the write path"), ("q8", "parse_graph #Bucket fn"),
    ("q9", "quota ticket revision ledger snapshot"), ("q10", "zzz_nothing_like_this"),
)


def _asked(spark):
    return spark.createDataFrame(list(QUERIES_ASKED), "query_id string, query string")


def _docs(spark, d):
    return lexical.distinct_documents(table(spark, d, "lexical_docs"))


def token_stats(spark, d):
    return lexical.token_stats(table(spark, d, "documents"))


def bm25_topk(spark, d):
    return lexical.bm25(_docs(spark, d), _asked(spark))


def postings(spark, d):
    return lexical.postings(_docs(spark, d)).select("entity_id", "term", "tf", "n_terms")


def bm25_indexed(spark, d):
    """As bm25_topk, from the tables of an inverted index."""
    index = lexical.stored_index(table(spark, d, "lexical_docs"))
    return lexical.bm25(_docs(spark, d), _asked(spark), index=(index["postings"], index["lexical_stats"]))


def exact_pools(spark, d):
    docs, q = _docs(spark, d), _asked(spark)
    out = exact.path_pool(docs, q).withColumn("pool", F.lit("exact_path"))
    out = out.unionByName(exact.symbol_pool(docs, q).withColumn("pool", F.lit("exact_symbol")))
    return out.unionByName(exact.identifier_pool(docs, q).withColumn("pool", F.lit("exact_identifier")))


def exact_names(spark, d):
    return exact.metadata_pool(table(spark, d, "files"), table(spark, d, "symbols"), _asked(spark))


def _pools(spark, d):
    docs, q, by_id = _docs(spark, d), _asked(spark), [F.asc("entity_id")]
    return fusion.pools_union(
        fusion.pool("lexical", lexical.bm25(docs, q), [F.asc("rank")]), fusion.pool("exact_path", exact.path_pool(docs, q), by_id),
        fusion.pool("exact_symbol", exact.symbol_pool(docs, q), by_id), fusion.pool("exact_identifier", exact.identifier_pool(docs, q), by_id))


def rrf_fusion(spark, d):
    return fusion.fuse(_pools(spark, d), _docs(spark, d)).select(
        "query_id", "entity_id", F.round("score", 6).alias("score"), "rank", F.transform("explanations", lambda x: F.concat_ws(" ", x["scorer"], x["explanation"])).alias("why"))


def candidate_bound(spark, d):
    return fusion.candidate_counts(_pools(spark, d))


def first_paths(spark, d):
    docs = _docs(spark, d)
    ranked = fusion.fuse(_pools(spark, d), docs).join(docs.select("entity_id", "path"), "entity_id")
    return packet.first_of_paths(ranked).select("query_id", "path", "entity_id", "place")


def federated_merge(spark, d):
    docs = _docs(spark, d)
    hits = lexical.bm25(docs, _asked(spark)).join(docs.select("entity_id", "repository"), "entity_id")
    from pyspark.sql import Window

    local = hits.withColumn("local_rank", F.row_number().over(Window.partitionBy("query_id", "repository").orderBy("rank")))
    return federation.federated(local.select("query_id", "repository", "local_rank", "score", "entity_id"), 50)


def ranking_quality(spark, d):
    docs, q = _docs(spark, d), _asked(spark)
    terms = q.select("query_id", F.explode(text_fn.query_terms(F.col("query"))).alias("term"))
    words = docs.select("entity_id", F.explode(F.array_distinct(text_fn.tokens(F.coalesce("body", F.lit(""))))).alias("term"))
    # Graded by how many of the query's terms a body has.
    judged = words.join(F.broadcast(terms), "term").groupBy("query_id", "entity_id").agg(F.least(F.lit(3), F.count("*")).cast("int").alias("gain"))
    out = metrics.ranking_quality(lexical.bm25(docs, q), judged)
    return out.select("query_id", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def graph_two_hop(spark, d):
    files = table(spark, d, "files")
    seeds = files.filter("language IS NOT NULL").select(F.lower("language").alias("query_id"), "generation_id", F.col("file_id").alias("node"))
    return graph.within_hops(seeds, graph.inner_edges(table(spark, d, "edges"))).groupBy("query_id", "generation_id").agg(F.count("*").alias("n_nodes"), F.min("entity_id").alias("first"), F.max("entity_id").alias("last"))


def edges_by_kind(spark, d):
    return exact.by_edge_kind(table(spark, d, "edges"), "calls", 1000).select("edge_id", "generation_id", "source_id", "source_line", "target")


def enclosing_range_join(spark, d):
    return resolve.enclosing_chunks(table(spark, d, "symbols"), table(spark, d, "chunks"))


def resolved_entities(spark, d):
    r = resolve.resolved_entities(table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "chunks"))
    return r.select("generation_id", "entity_id", "kind", "symbol", "start_line", F.md5("content").alias("content_md5"))


def entity_totals(spark, d):
    e = resolve.entities(table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "chunks"))
    return e.groupBy("generation_id", "entity_kind").agg(F.count("*").alias("n_entities"))


def omission_reasons(spark, d):
    """Indexed documents against the graph as it is, under three sets of filters."""
    docs = _docs(spark, d)
    resolved = resolve.resolved_entities(table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "chunks"))
    last = sealed_order(table(spark, d, "generations")).filter("seq = n_seq").select("generation_id")
    resolved = resolved.join(last, "generation_id")
    filters = spark.createDataFrame([("all", None, None, None, None, None), ("src", None, None, "src/", None, ["symbol"]), ("go", None, None, None, "go", None)], engine.REQUESTS.replace("query string, budget int, max_results int, ", ""))
    candidates = docs.select("entity_id", *resolve.AGREEING).crossJoin(F.broadcast(filters.select("query_id")))
    return resolve.with_reasons(candidates, resolved, filters).groupBy("query_id", "kind", "reason").agg(F.count("*").alias("n"))


def vector_targets(spark, d):
    ids = table(spark, d, "vectors").select("entity_id").distinct()
    known = table(spark, d, "symbols").select(F.col("symbol_id").alias("entity_id")).unionByName(table(spark, d, "chunks").select(F.col("chunk_id").alias("entity_id"))).distinct().withColumn("known", F.lit(True))
    return ids.join(known, "entity_id", "left").select("entity_id", F.when(F.col("known").isNull(), "stale").alias("reason"))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), "embedding", "vec_id")
    asked = [(r.entity_id, r.embedding) for r in e.filter("vec_id % 50 = 0").select("entity_id", "embedding").limit(flat_vectors.MOST_QUERIES + 1).collect()]
    return flat_vectors.top_k(e, asked, 10).select("query_id", "entity_id", "rank", F.round("cosine", 6).alias("cosine"))


#: Statements of which the first two pairs contradict and the last does not, as (item_id, text).
STATEMENTS = (
    (-1, "Parallel compaction of the ledger is enabled in every region."), (-2, "Parallel compaction of the ledger is disabled in every region."),
    (-3, "The archive must keep old tickets for a year."), (-4, "The archive must not keep old tickets for a year."),
    (-5, "Each queue must drain slowly."), (-6, "Each parser must not drain memory."), (-7, None), (-8, ""),
)


def contradictory_pairs(spark, d):
    """Opposing texts among the test items of a suite, and among a few statements."""
    from pyspark.sql import Window

    statements = spark.createDataFrame(list(STATEMENTS), "item_id long, text string").withColumn("suite", F.lit("statements"))
    items = table(spark, d, "eval_items").select("item_id", "text", "suite").unionByName(statements)
    items = items.select(F.col("suite").alias("query_id"), F.row_number().over(Window.partitionBy("suite").orderBy("item_id")).alias("position"), F.col("text").alias("content"))
    return contradiction.contradictions(items)


def assertions(spark, d):
    w = text_fn.assertion_words(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", text_fn.states(w).alias("states"), text_fn.denies(w).alias("denies"))


def query_parts(spark, d):
    t = F.col("text")
    return table(spark, d, "eval_items").select(
        "item_id", F.array_join(text_fn.query_terms(t), " ").alias("terms"), F.array_join(text_fn.exact_terms(t), " ").alias("exact"), F.array_join(text_fn.identifier_terms(t), " ").alias("identifiers"))


def line_excerpts(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.md5(text_fn.line_excerpt(F.col("text"), F.lit(2), F.lit(4))).alias("joined"), F.md5(text_fn.resolved_excerpt(F.col("text"), F.lit(1), F.lit(2), F.lit(4))).alias("kept"),
                    F.md5(text_fn.exact_lines(F.col("text"), F.lit(2), F.lit(4))).alias("exact"))


def path_languages(spark, d):
    return table(spark, d, "files").select("path", text_fn.language_of_path(F.col("path")).alias("detected")).distinct().groupBy("detected").agg(F.count("*").alias("n_paths"))


def framed_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", framed_id("doc", F.col("source"), F.col("doc_id")).alias("framed"))


def search_packets(spark, d):
    """Packets of the batch in the last sealed generation of every repository, documents made from its rows.

    One row for each query and repository; ``merged_ranks`` are the places of its
    items among those of all repositories.
    """
    last = sealed_order(table(spark, d, "generations")).filter("seq = n_seq").select("generation_id", F.col("repository_id").alias("repository"))
    last = cut(last)
    near = broadcast_if_small(last.select("generation_id"))
    t = {n: table(spark, d, n).join(near, "generation_id", "left_semi") for n in ("files", "symbols", "chunks", "edges")}
    r = cut(resolve.resolved_entities(t["files"], t["symbols"], t["chunks"]))
    docs = r.filter("kind <> 'file'").select("generation_id", "entity_id", "repository", "revision", "path", "language", "symbol", F.col("content").alias("body"), "start_line", "end_line", "kind")
    requests = engine.requests_frame(spark, [engine.Request(q, i) for i, q in QUERIES_ASKED])
    found = engine.search_each(requests, last, docs, t["files"], t["symbols"], t["edges"], r, on_overflow="truncate")
    return federation.with_places(cut(found.join(last, "generation_id")))


_ASKED = "asked(query_id, query) AS (VALUES " + ", ".join("('{}', '{}')".format(i, q.replace("'", "''")) for i, q in QUERIES_ASKED) + ")"
_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) <= 254)"
_PARTS = "list_transform(regexp_split_to_array({0}, '\\s+'), lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}_/.:#-]+|[^\\p{{L}}\\p{{N}}_/.:#-]+$', '', 'g'))"
_EXACT = "list_sort(list_distinct(list_filter(" + _PARTS + ", lambda t: t <> '')))"
_CODE = "(regexp_matches(t, '[_:#]') OR regexp_matches(t, '(?s)^.+[A-Z]'))"
_BM25 = f"""{_ASKED},
  docs AS (SELECT DISTINCT * FROM lexical_docs),
  tok AS (SELECT entity_id, path, kind, len(t) AS n, unnest(t) AS term FROM (SELECT entity_id, path, kind, {_TOK.format('body')} AS t FROM docs)),
  qt AS (SELECT query_id, unnest(list_distinct({_TOK.format('query')})) AS term FROM asked),
  tf AS (SELECT entity_id, path, kind, n, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  st AS (SELECT count(*) AS nd, avg(len({_TOK.format('body')})) AS al FROM docs),
  sc AS (SELECT query_id, entity_id, path, kind, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / al))), 6) AS score
         FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY ALL),
  lex AS (SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path NULLS FIRST, kind, entity_id) AS rank FROM sc)"""
_EXACTS = f"""
  xp AS (SELECT DISTINCT query_id, entity_id FROM (SELECT query_id, unnest(list_append({_EXACT.format('query')}, trim(query))) AS term FROM asked) JOIN docs ON docs.path = term),
  xs AS (SELECT DISTINCT query_id, entity_id FROM (SELECT query_id, unnest({_EXACT.format('query')}) AS term FROM asked) JOIN docs ON docs.symbol = term),
  xt AS (SELECT query_id, unnest(CASE WHEN len(e) = 1 THEN e ELSE list_filter(e, lambda t: {_CODE}) END) AS raw FROM (SELECT query_id, {_EXACT.format('query')} AS e FROM asked)),
  xi AS (SELECT DISTINCT query_id, entity_id FROM (SELECT query_id, {_TOK.format('raw')} AS t FROM xt) JOIN docs ON len(t) = 1 AND list_contains({_TOK.format('body')}, t[1]))"""
_FUSED = f"""{_BM25}, {_EXACTS},
  pools AS (
    SELECT query_id, 'lexical' AS pool, 0 AS o, 1.0 AS w, entity_id, rank FROM lex WHERE rank <= 257
    UNION ALL SELECT query_id, 'exact_path', 1, 2.0, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) FROM xp
    UNION ALL SELECT query_id, 'exact_symbol', 2, 2.0, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) FROM xs
    UNION ALL SELECT query_id, 'exact_identifier', 3, 1.5, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) FROM xi),
  act AS (SELECT query_id, sum(w) AS total FROM (SELECT DISTINCT query_id, pool, w FROM pools) GROUP BY 1),
  fu AS (SELECT query_id, entity_id, round(sum(w / total / (60 + rank)), 9) AS score, list(pool || ' ' || printf('w=%.3f,r=%d', (w / total)::DOUBLE, rank) ORDER BY o) AS why FROM pools JOIN act USING (query_id) GROUP BY 1, 2),
  fused AS (SELECT fu.*, d.path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.path NULLS FIRST, d.symbol NULLS FIRST, entity_id) AS rank FROM fu LEFT JOIN docs d USING (entity_id))"""
_LINKS = """e AS (SELECT DISTINCT generation_id, source_id AS a, target AS b FROM edges WHERE target IS NOT NULL AND NOT coalesce(target_is_external, false)),
  l AS (SELECT * FROM e WHERE a <> b UNION SELECT generation_id, b, a FROM e WHERE a <> b)"""
_ENCLOSING = """en AS (SELECT s.generation_id, s.symbol_id, arg_min(c.chunk_id, (c.end_line - c.start_line, c.chunk_id)) AS chunk_id
  FROM symbols s JOIN chunks c ON c.file_id = s.file_id AND c.start_line <= s.start_line AND c.end_line >= s.end_line GROUP BY 1, 2)"""

QUERIES = {
    f.__name__: f for f in (
        token_stats, postings, bm25_topk, bm25_indexed, exact_pools, exact_names, rrf_fusion, candidate_bound, first_paths, federated_merge, ranking_quality, graph_two_hop, edges_by_kind,
        enclosing_range_join, resolved_entities, entity_totals, omission_reasons, vector_targets, cosine_topk, contradictory_pairs, assertions, query_parts, line_excerpts, path_languages, framed_ids, search_packets)
}

_LANGUAGES = ", ".join(f"('{e}', '{n}')" for e, n in text_fn.LANGUAGE_BY_EXTENSION.items())
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_STATES = """(list_has_any(w, ['enabled', 'true']) OR len(list_filter(range(1, len(w) + 1), lambda i: (w[i] IN ('support', 'supports') AND (i = 1 OR w[i - 1] <> 'not'))
  OR (w[i] = 'must' AND (i = len(w) OR w[i + 1] <> 'not')))) > 0)"""
_DENIES = """(list_has_any(w, ['disabled', 'false']) OR len(list_filter(range(1, len(w) + 1), lambda i: (w[i] IN ('support', 'supports') AND i > 1 AND w[i - 1] = 'not')
  OR (w[i] = 'must' AND i < len(w) AND w[i + 1] = 'not'))) > 0)"""

_STATEMENTS = ", ".join(f"({i}, {'NULL' if t is None else repr(t) if t else chr(39) * 2})" for i, t in STATEMENTS)

SQL = {
    "token_stats": f"""WITH t AS (SELECT rowid AS i, unnest({_TOK.format('text')}) AS term FROM (SELECT row_number() OVER () AS rowid, text FROM documents))
      SELECT term, count(DISTINCT i) AS df, count(*) AS cf FROM t GROUP BY 1""",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM lex WHERE rank <= 257",
    "bm25_indexed": f"WITH {_BM25} SELECT * FROM lex WHERE rank <= 257",
    "postings": f"WITH {_BM25} SELECT entity_id, term, count(*) AS tf, n AS n_terms FROM tok GROUP BY entity_id, term, n",
    "exact_pools": f"WITH {_BM25}, {_EXACTS} SELECT *, 'exact_path' AS pool FROM xp UNION ALL SELECT *, 'exact_symbol' FROM xs UNION ALL SELECT *, 'exact_identifier' FROM xi",
    "exact_names": f"""WITH {_ASKED}, t AS (SELECT query_id, unnest({_EXACT.format('query')}) AS term FROM asked)
      SELECT DISTINCT query_id, entity_id FROM t JOIN (SELECT path AS name, file_id AS entity_id FROM files UNION ALL SELECT name, symbol_id FROM symbols) n ON n.name = t.term""",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, entity_id, round(score, 6) AS score, rank, why FROM fused",
    "candidate_bound": f"WITH {_FUSED} SELECT query_id, count(DISTINCT entity_id) AS n_candidates FROM pools GROUP BY 1",
    "first_paths": f"""WITH {_FUSED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS n FROM fused),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM b WHERE n = 1) SELECT query_id, path, entity_id, place FROM p WHERE place <= 3""",
    "federated_merge": f"""WITH {_BM25}, h AS (SELECT lex.*, docs.repository FROM lex JOIN docs USING (entity_id) WHERE rank <= 257),
      l AS (SELECT query_id, repository, score, entity_id, row_number() OVER (PARTITION BY query_id, repository ORDER BY rank) AS local_rank FROM h),
      m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repository, local_rank) AS merged_rank FROM l) SELECT * FROM m WHERE merged_rank <= 50""",
    "ranking_quality": f"""WITH {_BM25}, j AS (SELECT query_id, entity_id, least(3, count(DISTINCT term)) AS gain FROM tok JOIN qt USING (term) GROUP BY 1, 2),
      i AS (SELECT query_id, count(*) AS n, list_sum([(pow(2, g[k]) - 1) / log2(k + 1) for k in range(1, least(10, len(g)) + 1)]) AS ideal FROM (SELECT query_id, list(gain ORDER BY gain DESC) AS g, count(*) FROM j GROUP BY 1) t GROUP BY query_id, g, ideal),
      c AS (SELECT query_id, count(*) AS n FROM j GROUP BY 1),
      r AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, count(*) AS found FROM lex JOIN j USING (query_id, entity_id) WHERE rank <= 10 GROUP BY 1)
      SELECT query_id, round(coalesce(found, 0) / c.n, 6) AS recall, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM c JOIN i USING (query_id) LEFT JOIN r USING (query_id)""",
    "graph_two_hop": f"""WITH {_LINKS}, s AS (SELECT DISTINCT lower(language) AS query_id, generation_id, file_id AS node FROM files WHERE language IS NOT NULL),
      h1 AS (SELECT DISTINCT s.query_id, s.generation_id, l.b AS node FROM s JOIN l ON l.generation_id = s.generation_id AND l.a = s.node),
      h2 AS (SELECT DISTINCT h1.query_id, h1.generation_id, l.b AS node FROM h1 JOIN l ON l.generation_id = h1.generation_id AND l.a = h1.node),
      n AS ((SELECT * FROM h1 UNION SELECT * FROM h2) EXCEPT SELECT * FROM s)
      SELECT query_id, generation_id, count(*) AS n_nodes, min(node) AS first, max(node) AS last FROM n GROUP BY 1, 2""",
    "edges_by_kind": """SELECT edge_id, generation_id, source_id, source_line, target FROM edges WHERE edge_kind = 'calls'
      ORDER BY source_id, source_line, target NULLS FIRST, edge_id LIMIT 1000""",
    "enclosing_range_join": f"WITH {_ENCLOSING} SELECT * FROM en",
    "resolved_entities": f"""WITH {_ENCLOSING}, f AS (SELECT DISTINCT generation_id, file_id FROM files), c AS (SELECT DISTINCT generation_id, chunk_id, file_id, start_line, end_line, text FROM chunks),
      s AS (SELECT DISTINCT generation_id, symbol_id, file_id, name, start_line, end_line FROM symbols),
      x AS (SELECT s.generation_id, symbol_id AS entity_id, s.file_id, 'symbol' AS kind, name AS symbol, s.start_line,
              array_to_string(list_slice(list_filter(regexp_extract_all(c.text, '[^\\n]*\\n?'), lambda t: t <> ''), greatest(1, s.start_line - c.start_line + 1), s.end_line - c.start_line + 1), '') AS content, c.text
            FROM s LEFT JOIN en USING (generation_id, symbol_id) LEFT JOIN (SELECT DISTINCT chunk_id, start_line, text FROM chunks) c USING (chunk_id)),
      r AS (SELECT generation_id, file_id AS entity_id, file_id, 'file' AS kind, NULL AS symbol, 1 AS start_line, NULL AS content FROM f
            UNION ALL SELECT generation_id, chunk_id, file_id, 'chunk', NULL, coalesce(start_line, 1), text FROM c
            UNION ALL SELECT generation_id, entity_id, file_id, kind, symbol, start_line, CASE WHEN text IS NULL THEN NULL ELSE content END FROM x)
      SELECT generation_id, entity_id, kind, symbol, start_line, md5(content) AS content_md5 FROM r JOIN f USING (generation_id, file_id)""",
    "entity_totals": """SELECT generation_id, entity_kind, count(*) AS n_entities FROM (
      SELECT DISTINCT generation_id, file_id, 'file' AS entity_kind FROM files UNION SELECT DISTINCT generation_id, symbol_id, 'symbol' FROM symbols
      UNION SELECT DISTINCT generation_id, chunk_id, 'chunk' FROM chunks) GROUP BY 1, 2""",
    "vector_targets": """SELECT DISTINCT entity_id, CASE WHEN entity_id IN (SELECT symbol_id FROM symbols UNION SELECT chunk_id FROM chunks) THEN NULL ELSE 'stale' END AS reason FROM vectors""",
    "cosine_topk": """WITH e AS (SELECT vec_id, vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings),
      p AS (SELECT a.id AS query_id, b.id AS entity_id, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, entity_id) AS rank FROM p) SELECT query_id, entity_id, rank, round(c, 6) AS cosine FROM r WHERE rank <= 10""",
    "assertions": f"SELECT doc_id, {_STATES} AS states, {_DENIES} AS denies FROM (SELECT doc_id, {_WORDS.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents)",
    "contradictory_pairs": f"""WITH a AS (SELECT suite, item_id, text FROM eval_items UNION ALL SELECT 'statements', * FROM (VALUES {_STATEMENTS})),
      i AS (SELECT suite, row_number() OVER (PARTITION BY suite ORDER BY item_id) AS position, {_WORDS.format("coalesce(text, '')")} AS w FROM a),
      p AS (SELECT suite, position, {_STATES} AS yes, {_DENIES} AS no, list_distinct(list_filter(w, lambda x: x NOT IN ({', '.join(repr(x) for x in text_fn.NO_CONTEXT)}))) AS c FROM i)
      SELECT a.suite AS query_id, a.position AS a, b.position AS b FROM p a JOIN p b ON a.suite = b.suite AND a.position < b.position
      WHERE ((a.yes AND b.no) OR (a.no AND b.yes)) AND len(a.c) > 0 AND len(b.c) > 0 AND len(list_intersect(a.c, b.c)) * 4 >= greatest(len(a.c), len(b.c)) * 3""",
    "query_parts": f"""SELECT item_id, array_to_string(list_sort(list_distinct({_TOK.format('text')})), ' ') AS terms, array_to_string(e, ' ') AS exact,
      array_to_string(CASE WHEN len(e) = 1 THEN e ELSE list_filter(e, lambda t: {_CODE}) END, ' ') AS identifiers FROM (SELECT *, {_EXACT.format('text')} AS e FROM eval_items)""",
    "line_excerpts": """WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks),
      l AS (SELECT chunk_id, list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS a, list_filter(regexp_extract_all(text, '[^\\n]*\\n?'), lambda t: t <> '') AS k FROM c)
      SELECT chunk_id, md5(array_to_string(a[2:4], chr(10))) AS joined, md5(array_to_string(k[2:4], '')) AS kept, CASE WHEN len(a) >= 4 THEN md5(array_to_string(a[2:4], chr(10))) END AS exact FROM l""",
    "path_languages": f"""WITH m(e, n) AS (VALUES {_LANGUAGES}), p AS (SELECT DISTINCT path, lower(regexp_extract(path, '(?:^|/)[^/]+\\.([^./]+)$', 1)) AS x FROM files)
      SELECT n AS detected, count(*) AS n_paths FROM p LEFT JOIN m ON m.e = p.x GROUP BY 1""",
    "framed_ids": """SELECT doc_id, 'doc_' || sha256(unhex(f('doc') || hex_of) ) AS framed FROM (SELECT doc_id, '' AS hex_of FROM documents)""",
}
_LE = "printf('%02x00000000000000', strlen({0})) || hex(encode({0}))"
SQL["framed_ids"] = f"""SELECT doc_id, 'doc_' || sha256(unhex(lower({_LE.format("'doc'")} || {_LE.format("source")} || {_LE.format("doc_id::VARCHAR")}))) AS framed FROM documents"""
SQL["ranking_quality"] = f"""WITH {_BM25}, j AS (SELECT query_id, entity_id, least(3, count(DISTINCT term)) AS gain FROM tok JOIN qt USING (term) GROUP BY 1, 2),
      g AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS k FROM j),
      i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN k <= 10 THEN (pow(2, gain) - 1) / log2(k + 1) END) AS ideal FROM g GROUP BY 1),
      r AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, count(*) AS found FROM lex JOIN j USING (query_id, entity_id) WHERE rank <= 10 GROUP BY 1)
      SELECT query_id, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN r USING (query_id)"""
