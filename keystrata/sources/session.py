"""What a session needs to run this package's Python functions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package even when only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{_ROOT}:{have}" if have else _ROOT
    if spark.conf.get(_ROWS, None) is None:  # nobody chose; batches of long texts shall stay small on either side
        spark.conf.set(_ROWS, "2048")


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
