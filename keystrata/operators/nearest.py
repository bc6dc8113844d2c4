"""Nearest other point of each of a set of query points, block against block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024


def blocks(df: DataFrame, key: str, vector: str, rows: int = ROWS) -> DataFrame:
    """Points as blocks: keys and a matrix, as bytes."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                keys = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                matrix = np.array(b.column(1).to_pylist(), "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["keys", "matrix"])

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "keys binary, matrix binary")


def nearest(points: DataFrame, queries: DataFrame, key: str, vector: str, digits: int = 6) -> DataFrame:
    """key and nearest: of the points other than itself the closest, the least key among those equally close to so many digits.

    Query blocks go to every share of the point blocks (an equi-join on the share, nothing is broadcast), and
    a task compares two blocks at a time; minima are aggregated before they are shuffled.
    """
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks(points, key, vector).withColumn("share", F.pmod(F.xxhash64("keys"), F.lit(shares)).cast("int"))
    right = blocks(queries, key, vector).select(F.col("keys").alias("qk"), F.col("matrix").alias("qm"))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, m, qk, qm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, qk = np.frombuffer(k, "<i8"), np.frombuffer(qk, "<i8")
                m, qm = np.frombuffer(m, "<f8").reshape(len(k), -1), np.frombuffer(qm, "<f8").reshape(len(qk), -1)
                best, found = np.empty(len(qk)), np.empty(len(qk), "i8")
                for i, v in enumerate(qm):
                    d = np.sqrt(((m - v) ** 2).sum(axis=1)).round(digits)
                    d[k == qk[i]] = np.inf
                    j = np.lexsort((k, d))[0]
                    best[i], found[i] = d[j], k[j]
                yield pa.RecordBatch.from_arrays([pa.array(qk), pa.array(best), pa.array(found)], names=["q", "d", "k"])

    each = left.join(right, "share").select("keys", "matrix", "qk", "qm").mapInArrow(run, "q bigint, d double, k bigint")
    return each.filter("d < double('Infinity')").groupBy(F.col("q").alias(key)).agg(F.min(F.struct("d", "k"))["k"].alias("nearest"))
