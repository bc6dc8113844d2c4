"""Differences between two copies of a versioned table, and what resolves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    """key, a_version, b_version, state for keys that differ: missing on a side, or outdated there (one full join)."""
    left, right = a.select(key, F.col(version).alias("a_version")), b.select(key, F.col(version).alias("b_version"))
    va, vb = F.col("a_version"), F.col("b_version")
    state = F.when(va.isNull(), "a_missing").when(vb.isNull(), "b_missing").when(va < vb, "a_outdated").when(va > vb, "b_outdated")
    return left.join(right, key, "full_outer").withColumn("state", state).filter("state IS NOT NULL")


def by_hash(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    """Entries of a whose hashed (key, version) b doesn't have."""
    sign = F.xxhash64(key, version)
    return a.withColumn("_h", sign).join(b.select(sign.alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def resolve(stored: DataFrame, offered: DataFrame, key: str, version: str, value: str, locked: Column) -> DataFrame:
    """The stored table after newer entries were offered: update if unlocked and older, regen if absent, else as it is."""
    o = offered.select(key, F.col(version).alias("_v"), F.col(value).alias("_x"))
    both = stored.withColumn("_lock", locked).join(o, key, "full_outer")
    old, new = F.col(version), F.col("_v")
    action = F.when(old.isNull(), "regen").when(new.isNotNull() & (old < new) & ~F.col("_lock"), "update").otherwise("keep")
    take = F.col("action") != "keep"
    both = both.withColumn("action", action)
    return both.select(key, F.when(take, new).otherwise(old).alias(version), F.when(take, F.col("_x")).otherwise(F.col(value)).alias(value), "action")


def split3(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side: only in the left table, in both, or only in the right."""
    left, right = a.select(key).distinct().withColumn("_l", F.lit(1)), b.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))
