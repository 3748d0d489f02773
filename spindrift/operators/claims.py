"""Claims of notes: impact of changes, the queue of updates, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import citations
from spindrift.operators.validation import last_written

#: Confidence from which an inferred anchor counts, and counts fully.
STALE_FROM, PENDING_FROM = 0.60, 0.85
STATUSES = ("current", "stale", "pending_update", "broken")
REVIEWS = ("reviewed", "unreviewed")


def impact(confidence: Column, resolution: Column) -> Column:
    """Severity of one anchor: 3 broken, 2 pending update, 1 stale, 0 none.

    A null confidence is an explicit anchor.
    """
    explicit = confidence.isNull()
    return (
        F.when(resolution == "unresolvable", F.when(explicit, 3).otherwise(0))
        .when(resolution == "direct", F.when(explicit | (confidence >= PENDING_FROM), 2).when(confidence >= STALE_FROM, 1).otherwise(0))
        .when(resolution == "transitive", F.when(explicit | (confidence >= STALE_FROM), 1).otherwise(0))
        .otherwise(0)
    )


def next_statuses(claims: DataFrame, anchors: DataFrame, affected: DataFrame) -> DataFrame:
    """Status of each claim after a change: (claim_id, status).

    ``claims``: claim_id, status (null counts as current); ``anchors``:
    claim_id, repo, path, symbol, confidence; ``affected``: repo, path, symbol,
    resolution. The gravest anchor decides; without one the status stays.
    """
    key = ["repo", "path", "symbol"]
    worst = (
        anchors.join(affected.select(*key, "resolution").distinct(), key, "left")
        .groupBy("claim_id").agg(F.max(impact(F.col("confidence"), F.col("resolution"))).alias("severity"))
    )
    return claims.join(worst, "claim_id", "left").select(
        "claim_id", F.when(F.col("severity") == 3, "broken").when(F.col("severity") == 2, "pending_update").when(F.col("severity") == 1, "stale")
        .otherwise(F.coalesce("status", F.lit("current"))).alias("status"))


def claims_with_status(claims: DataFrame, status: str | None = None) -> DataFrame:
    """Claims in the order of note and id, of one status or all."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"no status {status}")
    return (claims if status is None else claims.filter(F.col("status") == status)).orderBy("note_path", "claim_id")


def claim(claims: DataFrame, claim_id: str) -> DataFrame:
    """The claim with an id; of several the one in the first note."""
    return claims.filter(F.col("claim_id") == claim_id).orderBy("note_path").limit(1)


def claim_snapshot(status: Column, review: Column, body: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), review.alias("review"), body.alias("body")))


def queued_updates(queue: DataFrame) -> DataFrame:
    """The queue's last entry of each note and claim, in the order they came.

    Columns that the queue holds as JSON arrays in the exchange format are
    arrays here. Repeated rows collapse; a later entry replaces an earlier one.
    """
    return last_written(queue, ["note_path", "claim_id"], ["queued_at"]).orderBy("queued_at", "note_path", "claim_id")


def allowed_citations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(generation_id, repo, path, symbol) that a patch may cite."""
    f = files.select("generation_id", "file_id", F.col("repository_id").alias("repo"), "path").distinct()
    return symbols.select("generation_id", "file_id", F.col("name").alias("symbol")).distinct().join(f, ["generation_id", "file_id"]).select("generation_id", "repo", "path", "symbol").distinct()


def judged_patches(patches: DataFrame, queue: DataFrame, notes: DataFrame, allowed: DataFrame, current: DataFrame) -> DataFrame:
    """Why each proposed patch is rejected, null if it may be applied.

    ``patches``: note_path, claim_id, body; ``notes``: note_path, claim_id,
    region_start, region_end; ``current``: generation_id, worktree_base_oid,
    worktree_dirty_digest (one row). Reasons in order: not_queued,
    stale_generation, claim_not_found, region_moved, citation_not_allowed.
    """
    q = queued_updates(queue).select("note_path", "claim_id", "generation_id", "worktree_base_oid", "worktree_dirty_digest", "allowed_edit_start", "allowed_edit_end", F.lit(True).alias("queued"))
    now = current.select(F.col("generation_id").alias("g"), F.col("worktree_base_oid").alias("b"), F.col("worktree_dirty_digest").alias("d"))
    key = ["note_path", "claim_id"]
    cited = patches.select(*key, F.explode(citations(F.col("body"))).alias("c")).select(*key, "c.*")
    foreign = cited.join(allowed.select("repo", "path", "symbol").distinct(), ["repo", "path", "symbol"], "left_anti").select(*key).distinct().withColumn("foreign", F.lit(True))
    j = patches.join(q, key, "left").join(notes.select(*key, "region_start", "region_end"), key, "left").join(foreign, key, "left").crossJoin(F.broadcast(now))
    moved = ~(F.col("region_start").eqNullSafe(F.col("allowed_edit_start")) & F.col("region_end").eqNullSafe(F.col("allowed_edit_end")))
    stale = ~(F.col("generation_id").eqNullSafe(F.col("g")) & F.col("worktree_base_oid").eqNullSafe(F.col("b")) & F.col("worktree_dirty_digest").eqNullSafe(F.col("d")))
    return j.select(*key, "body", F.when(F.col("queued").isNull(), "not_queued").when(stale, "stale_generation").when(F.col("region_start").isNull(), "claim_not_found")
                    .when(moved, "region_moved").when(F.col("foreign"), "citation_not_allowed").alias("reject_reason"))
