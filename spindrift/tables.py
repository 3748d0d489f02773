"""Reading tables, sizing shuffles and choosing join strategies.

Nothing here holds data on the driver; the only actions are row counts, which
Parquet answers from file footers, and checkpoints.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast (a few hundred bytes a row at most).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, rows_per_part: int) -> int:
    """Number of hash buckets that keeps a bucket near ``rows_per_part``."""
    return max(1, math.ceil(rows / max(1, rows_per_part)))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that at most ``limit`` rows exist.

    The count stops early: ``limit + 1`` rows are enough to decide. Beyond the
    bound the frame is returned as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most ``limit`` rows; also a bound for what derives from it."""
    return df.limit(limit + 1).count() <= limit


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches of text columns small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """The frame without its lineage, written to the shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names. Where it is unset,
    a session whose workers share one machine gets a folder that is removed at
    its end; on a cluster that is an error, since no folder is known to be shared.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spindrift-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def one_row(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the least of the other columns, taken in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
