"""Giving the workers this package, wherever the session was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_spindrift_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spindrift-")  # on the driver, which serves the file until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, os.path.join(folder, "src", "spindrift"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "spindrift"), "zip", os.path.join(folder, "src")))
    sc._spindrift_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
