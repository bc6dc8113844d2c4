"""Reads and writes of a versioned key-value table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(key: Column | str, lo, hi) -> Column:
    """Membership in the ring interval [lo, hi]: equal bounds mean the whole ring, lo above hi wraps around.

    Bounds are literals, so the predicate is a plain comparison that reaches the scan.
    """
    key = F.col(key) if isinstance(key, str) else key
    if lo == hi:
        return key.isNotNull()
    return key.between(lo, hi) if lo < hi else (key >= lo) | (key <= hi)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def points(df: DataFrame, key: str, values: list) -> DataFrame:
    """An interval of single elements is a list of point reads."""
    return df.filter(F.col(key).isin(values))


def latest(df: DataFrame, keys: list[str], version: str, values: list[str], tie: list[str] = ()) -> DataFrame:
    """Newest row of each key, by partial aggregation instead of a window over whole groups."""
    best = F.max_by(F.struct(*values), F.struct(version, *tie))
    return df.groupBy(*keys).agg(best.alias("_v"), F.max(version).alias(version)).select(*keys, version, "_v.*")


def quorum(replicas: DataFrame, key: str, version: str, value: str, r: int) -> DataFrame:
    """Newest version among the replicas that answered, for keys that a majority of r answered for."""
    got = replicas.groupBy(key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version), F.count(F.lit(1)).alias("replies"))
    return got.filter(F.col("replies") >= r // 2 + 1)


def ring_rank(key: Column, start) -> list[Column]:
    """Sort columns that begin at start and wrap around."""
    return [F.when(key >= start, 0).otherwise(1).asc(), key.asc()]


def chunk(df: DataFrame, key: str, start, lo, hi, n: int) -> DataFrame:
    """The first n rows inside the interval from start on, in ring order (a top-n, not a full sort)."""
    k = F.col(key)
    return df.filter(in_range(k, lo, hi)).orderBy(*ring_rank(k, start)).limit(n)


def fold_rows(df: DataFrame, key: str, lo, hi, n: int, descending: bool = False) -> DataFrame:
    """The rows that an ordered fold with a limit visits."""
    k = F.col(key)
    return df.filter(in_range(k, lo, hi)).orderBy(k.desc() if descending else k.asc()).limit(n)


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str, values: list[str]) -> DataFrame:
    """Latest state after writing changes: one union and one partial aggregation."""
    cols = [key, version, *values]
    return latest(base.select(*cols).unionByName(changes.select(*cols)), [key], version, values)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def delete_status(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What became of each deletion: ok, or undef where there was nothing."""
    have = base.select(F.col(key).alias("_k")).distinct().withColumn("_held", F.lit(True))
    out = keys.select(key).distinct().join(have, F.col(key) == F.col("_k"), "left")
    return out.groupBy(F.when(F.col("_held"), "ok").otherwise("undef").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def read_modify_write(df: DataFrame, value: str, read: Callable[[Column], Column], check: Callable[[Column], Column], write: Callable[[Column, Column], Column]) -> DataFrame:
    """df with the value replaced where the check passes, and written, which says so.

    read(value) is what of it the request looks at; check(seen) decides (null is no); write(value, seen) gives the new value.
    """
    seen = read(F.col(value))
    ok = F.coalesce(check(seen), F.lit(False))
    return df.withColumns({value: F.when(ok, write(F.col(value), seen)).otherwise(F.col(value)), "written": ok})
