"""Change events, coalesced into batches that rebuild a generation.

``coalesced`` groups the events of a log by quiet gaps in event time;
``coalesced_stream`` does the same on a stream with a watermark. Both bound the
paths of a batch: beyond the bound it asks for a full scan instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.checkout import accepted

#: Quiet gap, paths of a batch and of an event, failures in a row, bytes of a diagnostic and of a path.
QUIET_MS, MOST_PATHS, MOST_EVENT_PATHS, MOST_FAILURES, MOST_DIAGNOSTIC, MOST_PATH_BYTES = 250, 256, 64, 4, 1024, 4096


def path_decision(path: Column, include: list[str], exclude: list[str]) -> Column:
    """hint, ignore or reconcile for a path relative to the root; null lies outside."""
    odd = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return (
        F.when(path.isNull(), "reconcile").when(path == "", "ignore").when(odd | (F.octet_length(path) > MOST_PATH_BYTES), "reconcile")
        .when(~accepted(path, include, exclude), "ignore").otherwise("hint")
    )


def classified(events: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Events (source, seq, ts, kind, paths, message) with hints and flags.

    Kinds: access is ignored; rescan, and more than 64 paths, overflow;
    create_dir asks for reconciliation; error is a fault of the backend; any
    other kind hints at its paths, of which odd ones overflow.
    """
    decided = F.transform(F.coalesce("paths", F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), path_decision(p, list(include), list(exclude)).alias("what")))
    many = F.size(F.coalesce("paths", F.array().cast("array<string>"))) > MOST_EVENT_PATHS
    e = events.filter("kind <> 'access'").withColumn("d", decided)
    odd = F.exists("d", lambda x: x["what"] == "reconcile")
    plain = ~F.col("kind").isin("rescan", "error", "create_dir") & ~many
    return e.select(
        "source", "seq", "ts", "kind",
        F.when(plain, F.transform(F.filter("d", lambda x: x["what"] == "hint"), lambda x: x["path"])).otherwise(F.array().cast("array<string>")).alias("hints"),
        ((F.col("kind") == "rescan") | (many & (F.col("kind") != "error")) | (plain & odd)).alias("overflow"),
        ((F.col("kind") == "create_dir") & ~many).alias("reconcile"),
        F.when(F.col("kind") == "error", F.substring(F.coalesce("message", F.lit("")), 1, MOST_DIAGNOSTIC)).alias("fault"),
    ).filter("overflow OR reconcile OR fault IS NOT NULL OR size(hints) > 0")


def _batch_columns() -> list[Column]:
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_set("hints"))))
    full = F.bool_or(F.col("overflow") | F.col("reconcile") | F.col("fault").isNotNull()) | (F.size(paths) > MOST_PATHS)
    return [
        F.when(F.size(paths) > MOST_PATHS, F.array().cast("array<string>")).otherwise(paths).alias("paths"), full.alias("full_scan"),
        F.bool_or("overflow").alias("overflow"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("seq"))).alias("fault"), F.count("*").alias("n_events")]


def coalesced(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """One batch of each source for events with gaps of less than ``quiet_ms``."""
    gap = F.session_window("ts", f"{quiet_ms} milliseconds")
    return events.groupBy("source", gap.alias("w")).agg(*_batch_columns()).select("source", F.col("w.start").alias("started"), F.col("w.end").alias("emitted"), "paths", "full_scan", "overflow", "fault", "n_events")


def coalesced_stream(events: DataFrame, quiet_ms: int = QUIET_MS, lateness: str = "10 seconds") -> DataFrame:
    """:func:`coalesced` on a stream; a batch is emitted once the watermark passes it."""
    return coalesced(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), quiet_ms)


def islands(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Runs of rows of a key with gaps of at most ``gap_seconds``, by windows."""
    w = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.when(at - F.lag(at).over(w) <= int(gap_seconds * 1e6), 0).otherwise(1)
    return events.withColumn("island", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


class Retry:
    """What to do with a batch that failed; any event resets the count."""

    def __init__(self) -> None:
        self.failures, self.pending = 0, None

    def note_event(self) -> None:
        self.failures = 0

    def prepared(self, batch: dict) -> dict:
        """The batch, joined with one that waits; more than 256 paths are dropped, for a full scan."""
        if self.pending is None:
            return batch
        paths = sorted(set(self.pending["paths"]) | set(batch["paths"]))
        diagnostics = list(dict.fromkeys([*self.pending.get("diagnostics", []), *batch.get("diagnostics", [])]))[:2]
        self.pending = None
        return {"paths": [] if len(paths) > MOST_PATHS else paths, "full_scan": True, "diagnostics": diagnostics}

    def failed(self, batch: dict, retryable: bool) -> float | None:
        """Seconds to wait before the next try; None if it is over."""
        if not retryable:
            return None
        self.failures += 1
        if self.failures >= MOST_FAILURES:
            return None
        self.pending = batch
        return QUIET_MS / 1000 * self.failures


def rebuild_on_change(batches: DataFrame, rebuild: Callable[[list[str], bool], None], checkpoint: str, retryable: type[Exception] = OSError, sleep: Callable[[float], None] = time.sleep):
    """Start a stream that calls ``rebuild(paths, full_scan)`` for each batch.

    A failing call of a kind that may pass is tried again with growing pauses;
    after the last try the stream fails.
    """
    retry = Retry()

    def sink(df: DataFrame, _: int) -> None:
        rows = df.orderBy("emitted").collect()  # batches, each of bounded size
        if not rows:
            return
        retry.note_event()
        batch = retry.prepared({"paths": sorted({p for r in rows for p in r.paths}), "full_scan": any(r.full_scan for r in rows), "diagnostics": [r.fault for r in rows if r.fault]})
        while True:
            try:
                return rebuild(batch["paths"], batch["full_scan"])
            except retryable:
                wait = retry.failed(batch, True)
                if wait is None:
                    raise
                sleep(wait)
                batch = retry.prepared(batch)

    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
