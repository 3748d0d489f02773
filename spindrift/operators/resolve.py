"""Authoritative rows for candidates, and the reason for each one left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import resolved_excerpt
from spindrift.tables import one_row

#: What must agree between a candidate and its authoritative row.
AGREEING = ("repository", "revision", "path", "language", "kind", "symbol", "start_line", "end_line")


def enclosing_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each symbol the smallest chunk of its file that spans it.

    Result: generation_id, symbol_id, chunk_id. Equal sizes take the least
    chunk_id. Null lines span nothing. Joined by file, so a hot file is split by
    adaptive execution; the aggregate keeps one row a symbol.
    """
    s = symbols.select("generation_id", "symbol_id", "file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    c = chunks.select("file_id", "chunk_id", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    return (
        s.join(c, "file_id").filter("cs <= s AND ce >= e")
        .groupBy("generation_id", "symbol_id").agg(F.min(F.struct((F.col("ce") - F.col("cs")).alias("size"), "chunk_id")).alias("m"))
        .select("generation_id", "symbol_id", "m.chunk_id")
    )


def entities(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(generation_id, entity_id, entity_kind, file_id) of all three kinds, distinct."""
    return (
        files.select("generation_id", F.col("file_id").alias("entity_id"), F.lit("file").alias("entity_kind"), "file_id")
        .unionByName(symbols.select("generation_id", F.col("symbol_id").alias("entity_id"), F.lit("symbol").alias("entity_kind"), "file_id"))
        .unionByName(chunks.select("generation_id", F.col("chunk_id").alias("entity_id"), F.lit("chunk").alias("entity_kind"), "file_id"))
        .distinct()
    )


def resolved_entities(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every entity with its file, lines and content.

    Result: generation_id, entity_id, repository, revision, path, language,
    kind, symbol, start_line, end_line, content. A chunk's content is its text,
    a symbol's the lines it covers of its enclosing chunk, a file's null. An
    entity without a file row is left out. Of repeated rows one counts.
    """
    f = files.select("generation_id", "file_id", F.col("repository_id").alias("repository"), "revision", "path", "language")
    f = one_row(f, "generation_id", "file_id")
    c = one_row(chunks.select("generation_id", "chunk_id", "file_id", "start_line", "end_line", "text"), "generation_id", "chunk_id")
    s = one_row(symbols.select("generation_id", "symbol_id", "file_id", "name", "start_line", "end_line"), "generation_id", "symbol_id")
    around = s.join(enclosing_chunks(s, c), ["generation_id", "symbol_id"], "left").join(
        c.select("chunk_id", F.col("text").alias("around"), F.col("start_line").alias("offset")).dropDuplicates(["chunk_id"]), "chunk_id", "left")
    rows = (
        f.select("generation_id", F.col("file_id").alias("entity_id"), "file_id", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("symbol"),
                 F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("content"))
        .unionByName(c.select("generation_id", F.col("chunk_id").alias("entity_id"), "file_id", F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("symbol"),
                              F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), F.col("text").alias("content")))
        .unionByName(around.select("generation_id", F.col("symbol_id").alias("entity_id"), "file_id", F.lit("symbol").alias("kind"), F.col("name").alias("symbol"),
                                   "start_line", "end_line", resolved_excerpt(F.col("around"), F.col("offset"), F.col("start_line"), F.col("end_line")).alias("content")))
    )
    return rows.join(f, ["generation_id", "file_id"]).select("generation_id", "entity_id", "repository", "revision", "path", "language", "kind", "symbol", "start_line", "end_line", "content")


def with_reasons(candidates: DataFrame, resolved: DataFrame, requests: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with their authoritative row and why they are left out, if so.

    ``candidates`` carry query_id, entity_id and the eight columns of
    :data:`AGREEING`; ``requests`` carry query_id and the optional filters
    f_repository, f_revision, f_path_prefix, f_language, f_kinds. Reasons, the
    first that holds: stale, metadata_disagreement, metadata_filter,
    unresolvable, empty. Filters apply to the authoritative row, after ranking.
    Candidates meet rows that agree in the columns of ``scope``.
    """
    right = resolved.select(*scope, "entity_id", *(F.col(c).alias(f"r_{c}") for c in AGREEING), "content", F.lit(True).alias("known"))
    joined = candidates.join(right, [*scope, "entity_id"], "left").join(requests.select("query_id", "f_repository", "f_revision", "f_path_prefix", "f_language", "f_kinds"), "query_id")
    agree = F.lit(True)
    for c in AGREEING:
        agree = agree & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    passes = (
        (F.col("f_repository").isNull() | F.col("f_repository").eqNullSafe(F.col("r_repository")))
        & (F.col("f_revision").isNull() | F.col("f_revision").eqNullSafe(F.col("r_revision")))
        & (F.col("f_path_prefix").isNull() | F.coalesce(F.col("r_path").startswith(F.col("f_path_prefix")), F.lit(False)))
        & (F.col("f_language").isNull() | F.col("f_language").eqNullSafe(F.col("r_language")))
        & (F.col("f_kinds").isNull() | F.coalesce(F.array_contains("f_kinds", F.col("r_kind")), F.lit(False)))
    )
    reason = (
        F.when(F.col("known").isNull(), "stale").when(~agree, "metadata_disagreement").when(~passes, "metadata_filter")
        .when(F.col("content").isNull(), "unresolvable").when(F.trim(F.regexp_replace("content", r"\s+", " ")) == "", "empty")
    )
    return joined.withColumn("reason", reason).drop("known", "f_repository", "f_revision", "f_path_prefix", "f_language", "f_kinds", *(f"r_{c}" for c in AGREEING))


def omissions(*parts: DataFrame) -> DataFrame:
    """(query_id, entity_id, reason) of all parts, each once."""
    out = parts[0].select("query_id", "entity_id", "reason")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "entity_id", "reason"))
    return out.filter("reason IS NOT NULL").distinct()


def cited_evidence(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations (repository, revision, path, ...) whose file exists in the generation."""
    f = files.select(F.col("repository_id").alias("repository"), "revision", "path").distinct()
    return citations.join(f, ["repository", "revision", "path"], "left_semi")


def ordered_without_gap(paths: DataFrame, group: str, position: str, path: str) -> DataFrame:
    """Rows whose path does not come after that of the row before them."""
    w = Window.partitionBy(group).orderBy(position)
    return paths.withColumn("previous", F.lag(path).over(w)).filter(F.col(path) <= F.col("previous"))
