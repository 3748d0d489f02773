"""Checks of a generation. A check gives its violations; a sound one gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()))


def ownership(table: DataFrame, column: str, owner) -> DataFrame:
    """One row: all rows and those of the owner; sound if they agree."""
    return table.agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).eqNullSafe(owner)).alias("n_owned"))


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, name: str) -> DataFrame:
    """Distinct key values of ``child`` that ``parent`` lacks, as (check_name, key)."""
    lacking = child.select(*keys).dropna().distinct().join(parent.select(*keys).distinct(), keys, "left_anti")
    return lacking.select(F.lit(name).alias("check_name"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))


def foreign_keys(generations: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """All references of the schema that lead nowhere."""
    checks = [
        orphans(files, ["generation_id"], generations, "files.generation"),
        orphans(symbols, ["generation_id", "file_id"], files, "symbols.file"),
        orphans(chunks, ["generation_id", "file_id"], files, "chunks.file"),
        orphans(edges.select("generation_id", F.col("source_id").alias("file_id")), ["generation_id", "file_id"], files, "edges.source"),
    ]
    return reduce(DataFrame.unionByName, checks)


def entity_consistency(entities: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities without their row, and rows without their entity, by kind."""
    key = ["generation_id", "entity_id"]
    out = []
    for kind, table, col in (("file", files, "file_id"), ("symbol", symbols, "symbol_id"), ("chunk", chunks, "chunk_id")):
        rows = table.select("generation_id", F.col(col).alias("entity_id")).distinct()
        own = entities.filter(F.col("entity_kind") == kind).select(*key).distinct()
        out.append(own.join(rows, key, "left_anti").select(*key, F.lit(f"{kind} entity without row").alias("violation")))
        out.append(rows.join(own, key, "left_anti").select(*key, F.lit(f"{kind} row without entity").alias("violation")))
    return reduce(DataFrame.unionByName, out)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side, counted as often as the other lacks them.

    Equality of multisets: both sides are grouped once, by all columns.
    """
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("n")).unionByName(b.select(*cols, F.lit(-1).alias("n")))
    return both.groupBy(*cols).agg(F.sum("n").alias("surplus")).filter("surplus <> 0")


def upsert_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were inserted with different payloads."""
    payload = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.countDistinct(payload).alias("n_payloads"), F.count("*").alias("n_rows")).filter("n_payloads > 1")


def idempotent(rows: DataFrame) -> DataFrame:
    """Rows inserted once, however often they came."""
    return rows.distinct()


def last_written(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; of equal ones the greatest."""
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def same_in_index(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Where the lexical index and the graph disagree, on their common columns."""
    cols = ["entity_id", "path", "language", "symbol", "start_line", "end_line", "kind"]
    return differences(docs.select(*cols), resolved.select(*cols))


def health(generation_id: str, counts: DataFrame, violations: DataFrame, most: int = 1024) -> DataFrame:
    """One row: healthy, generation, counts by table, and a bounded issue text."""
    c = counts.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "n_rows"))).alias("counts"))
    v = violations.agg(F.count("*").alias("n_violations"), F.min(F.concat_ws(": ", "check_name", "key")).alias("first_issue"))
    return c.crossJoin(v).select((F.col("n_violations") == 0).alias("healthy"), F.lit(generation_id).alias("generation_id"), "counts", "n_violations", F.substring("first_issue", 1, most).alias("issue"))
