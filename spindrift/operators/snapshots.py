"""What changed between consecutive full snapshots of a table.

Every snapshot repeats the whole list of records. The operator hashes each
record at the scan to a 128-bit key and a 64-bit row hash, packs these as arrays
by hash bucket, keeps the latest delivery of a key first within a task and then
within its bucket, sorts every bucket's arrays in numpy and finds additions,
removals and changes of neighbouring snapshots with ``searchsorted``. Only the
arrays move, 48 bytes a record. Full values are fetched for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.tables import broadcast_if_small, cut, parts_for

#: Compact rows (48 bytes each) that one bucket should hold, and that a task packs at a time.
BUCKET_ROWS, PACKED_ROWS = 250_000, 500_000
#: Differing keys (28 bytes each) up to which they are broadcast to the scan.
BROADCAST_KEYS = 500_000

#: A record in a snapshot: key, places of the snapshot, time and order of the delivery, row hash.
COMPACT = np.dtype([("k1", "i8"), ("k2", "i8"), ("seq", "i4"), ("n_seq", "i4"), ("t", "i8"), ("prefix", "i8"), ("row", "i8")])

PACKED = "bucket int, records binary"
DIFF_SCHEMA = "k1 long, k2 long, seq int, change string"


def normal_digest(col: str) -> F.Column:
    """Digest without an ``algorithm:`` prefix, in lower case."""
    return F.lower(F.regexp_replace(F.col(col), r"^[A-Za-z0-9_-]+:", ""))


def micros(df: DataFrame, col: str) -> F.Column:
    """A time as a number, of which the order is kept; without a zone it is read as UTC."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")
    return F.unix_micros(F.col(col).cast("timestamp"))


def sealed_order(generations: DataFrame) -> DataFrame:
    """Sealed generations with their place in the repository's history.

    Columns: generation_id, repository_id, seq (from 1), n_seq. Repeated rows
    collapse; of rows that disagree, the latest ``sealed_at`` counts. Equal
    ``sealed_at`` are ordered by generation_id. Rows without an id or without
    ``sealed_at`` take no part.
    """
    one = (
        generations.filter("status = 'sealed' AND generation_id IS NOT NULL AND sealed_at IS NOT NULL")
        .groupBy("generation_id")
        .agg(F.max(F.struct("sealed_at", "repository_id")).alias("g"))
        .select("generation_id", "g.sealed_at", "g.repository_id")
    )
    per_repo = Window.partitionBy("repository_id")
    return one.select(
        "generation_id",
        "repository_id",
        F.row_number().over(per_repo.orderBy("sealed_at", "generation_id")).cast("int").alias("seq"),
        F.count("*").over(per_repo).cast("int").alias("n_seq"),
    )


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two long columns as one 16-byte key that sorts and compares in numpy."""
    both = np.empty((len(a), 2), dtype=">u8")
    both[:, 0] = a.astype(np.int64).view(np.uint64)
    both[:, 1] = b.astype(np.int64).view(np.uint64)
    return both.view("S16").ravel()


def _member(sorted_keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(probe), bool), np.zeros(len(probe), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, probe), len(sorted_keys) - 1)
    return sorted_keys[at] == probe, at


def diff_arrays(k1, k2, seq, row, n_seq) -> pd.DataFrame:
    """Added, removed and changed keys of each snapshot against the one before.

    Takes parallel arrays with one entry per (key, snapshot).
    """
    key = _keys(np.asarray(k1), np.asarray(k2))
    seq, row, n_seq = np.asarray(seq), np.asarray(row), np.asarray(n_seq)
    order = np.lexsort((key, seq))
    found: list[tuple[np.ndarray, int, str]] = []
    cuts = {s: order[np.searchsorted(seq[order], s) : np.searchsorted(seq[order], s, "right")] for s in np.unique(seq)}
    none = order[:0]
    for s in sorted({*cuts, *(c + 1 for c in cuts)}):
        if s < 2:
            continue
        before, now = cuts.get(s - 1, none), cuts.get(s, none)
        before = before[n_seq[before] >= s]  # the last snapshot has no successor
        known, at = _member(key[before], key[now])
        found.append((now[~known], s, "added"))
        same = now[known]
        found.append((same[row[same] != row[before[at[known]]]], s, "changed"))
        kept, _ = _member(key[now], key[before])
        found.append((before[~kept], s, "removed"))
    k1, k2 = np.asarray(k1), np.asarray(k2)
    parts = [pd.DataFrame({"k1": k1[i], "k2": k2[i], "seq": np.int32(s), "change": c}) for i, s, c in found if len(i)]
    return pd.concat(parts) if parts else pd.DataFrame({"k1": [0], "k2": [0], "seq": [0], "change": [""]})[:0]


def latest_of(records: np.ndarray) -> np.ndarray:
    """Of each key in a snapshot the record delivered last."""
    order = np.lexsort([records[c] for c in ("row", "prefix", "t", "seq", "k2", "k1")])
    r = records[order]
    last = np.ones(len(r), bool)
    last[:-1] = (r["k1"][1:] != r["k1"][:-1]) | (r["k2"][1:] != r["k2"][:-1]) | (r["seq"][1:] != r["seq"][:-1])
    return r[last]


def _packing(buckets: int):
    """Arrays of a task's records by bucket, of repeated ones only the latest."""

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        r = latest_of(np.concatenate(held))
        bucket = np.mod(r["k2"], buckets)
        order = np.argsort(bucket, kind="stable")
        r, bucket = r[order], bucket[order]
        numbers, starts = np.unique(bucket, return_index=True)
        return pd.DataFrame({"bucket": numbers.astype(np.int32), "records": [x.tobytes() for x in np.split(r, starts[1:])]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for f in frames:
            r = np.empty(len(f), COMPACT)
            for c in COMPACT.names:
                r[c] = f[c].to_numpy()
            held.append(r)
            if sum(map(len, held)) >= PACKED_ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _diff_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    r = latest_of(np.concatenate([np.frombuffer(b, COMPACT) for b in pdf.records]))
    return diff_arrays(r["k1"], r["k2"], r["seq"], r["row"], r["n_seq"])


def located(files: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of sealed generations with key, snapshot, time and normalised digest."""
    return (
        files.select("generation_id", "file_id", micros(files, "delivered_at").alias("t"), normal_digest("content_digest").alias("digest"))
        .filter("generation_id IS NOT NULL AND file_id IS NOT NULL")
        .join(order, "generation_id")
        .withColumns({"k1": F.xxhash64("repository_id", "file_id"), "k2": F.xxhash64("file_id", F.lit(7), "repository_id")})
        .withColumn("t", F.coalesce("t", F.lit(-(1 << 63))))
    )


def differing_keys(files: DataFrame, order: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(k1, k2, seq, change) of the keys that differ from the snapshot before."""
    first_bytes = F.rpad(F.hex(F.substring(F.encode("digest", "UTF-8"), 1, 7)), 14, "0")
    compact = located(files, order).select(
        "k1", "k2", "seq", "n_seq", "t",
        F.when(F.col("digest").isNull(), -1).otherwise(F.conv(first_bytes, 16, 10).cast("long")).alias("prefix"),
        F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("digest")), F.lit("null"))).alias("row"))
    packed = compact.mapInPandas(_packing(parts_for(files.count(), bucket_rows)), PACKED)
    return packed.groupBy("bucket").applyInPandas(_diff_bucket, DIFF_SCHEMA)


def snapshot_changes(files: DataFrame, generations: DataFrame, bucket_rows: int = BUCKET_ROWS, values: bool = True) -> DataFrame:
    """Changes of every sealed generation but the first of its repository.

    Result: generation_id (the later one), file_id, change (``added``,
    ``removed``, ``changed``), and, if ``values``, digest_before and
    digest_after; one row per key.

    * A key delivered more than once counts with its latest ``delivered_at``
      (null is earliest); of equal times the digest whose first seven bytes sort
      last counts, then the one with the greatest hash.
    * A null digest is a value of its own. Rows with a null generation_id or
      file_id are left out, as are rows of generations that are not sealed.
    * A sealed generation without any file removes all files of its predecessor.
    * Empty tables give an empty result. Extra columns are ignored.
    """
    order = broadcast_if_small(sealed_order(generations))
    differing = cut(differing_keys(files, order, bucket_rows))
    # The snapshots whose rows hold what is asked of a key.
    before = F.col("change").isin("removed", "changed") if values else F.col("change") == "removed"
    wanted = differing.select(
        "k1", "k2", F.col("seq").alias("at_seq"), "change",
        F.explode(F.filter(F.array(F.when(before, F.col("seq") - 1), F.when(F.col("change") != "removed", F.col("seq"))), lambda x: x.isNotNull())).alias("seq"))
    rows = located(files, order).select("k1", "k2", "seq", "repository_id", "file_id", *(["t", "digest"] if values else []))
    keys = broadcast_if_small(wanted.select("k1", "k2", "seq").distinct(), BROADCAST_KEYS)
    rows = rows.join(keys, ["k1", "k2", "seq"], "left_semi")
    later = broadcast_if_small(order.select("repository_id", F.col("seq").alias("at_seq"), "generation_id"))
    if not values:
        found = rows.groupBy("k1", "k2", "seq").agg(F.first("repository_id").alias("repository_id"), F.first("file_id").alias("file_id")).join(wanted, ["k1", "k2", "seq"])
        return found.join(later, ["repository_id", "at_seq"]).select("generation_id", "file_id", "change")
    first_bytes = F.rpad(F.hex(F.substring(F.encode("digest", "UTF-8"), 1, 7)), 14, "0")
    latest = F.max(F.struct("t", first_bytes.alias("prefix"), F.xxhash64(F.concat(F.lit("="), F.col("digest"))).alias("row"), "digest", "repository_id", "file_id"))
    full = (
        rows.groupBy("k1", "k2", "seq").agg(latest.alias("v")).join(wanted, ["k1", "k2", "seq"])
        .groupBy("v.repository_id", "v.file_id", "at_seq", "change")
        .agg(F.max(F.when(F.col("seq") < F.col("at_seq"), F.col("v.digest"))).alias("digest_before"),
             F.max(F.when(F.col("seq") == F.col("at_seq"), F.col("v.digest"))).alias("digest_after"))
    )
    return full.join(later, ["repository_id", "at_seq"]).select("generation_id", "file_id", "change", "digest_before", "digest_after")


def unconfirmed_evidence(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids that a queue row calls changed though its generation shows no change.

    Result: generation_id, evidence_id, one row each. Null and empty arrays,
    null elements and rows without a generation give nothing; a generation that
    is first, unknown or not sealed confirms nothing.
    """
    claimed = (
        queue.select("generation_id", F.explode("changed_evidence_ids").alias("evidence_id"))
        .filter("generation_id IS NOT NULL AND evidence_id IS NOT NULL")
        .distinct()
    )
    seen = changes.select("generation_id", F.col("file_id").alias("evidence_id"))
    return claimed.join(seen, ["generation_id", "evidence_id"], "left_anti")


def change_report(changes: DataFrame) -> DataFrame:
    """Number of changes by generation and kind."""
    return changes.groupBy("generation_id", "change").agg(F.count("*").alias("n_files"))


def evidence_changes(files: DataFrame, generations: DataFrame, queue: DataFrame) -> DataFrame:
    """Changes and unconfirmed queue evidence as (generation_id, evidence_id, change)."""
    changes = snapshot_changes(files, generations, values=False)
    return changes.select("generation_id", F.col("file_id").alias("evidence_id"), "change").unionByName(
        unconfirmed_evidence(queue, changes).withColumn("change", F.lit("unconfirmed")))
