"""Mergeable counters and sets as aggregates over their replicas' states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_counter(*states: DataFrame) -> DataFrame:
    """Element-wise maximum of states (name, replica, n)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("name", "replica").agg(F.max("n").alias("n"))


def counter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("name").agg(F.sum("n").alias("value"))


def counter_vector(state: DataFrame, replicas: int) -> DataFrame:
    """name, vector of a state; missing replicas count 0."""
    cells = [F.coalesce(F.max(F.when(F.col("replica") == r, F.col("n"))), F.lit(0)) for r in range(replicas)]
    return state.groupBy("name").agg(F.array(*cells).alias("v"))


def below(a: Column, b: Column) -> Column:
    """Whether vector a is nowhere above vector b."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)


def merge_orset(a: DataFrame, b: DataFrame, seen_a: DataFrame, seen_b: DataFrame) -> DataFrame:
    """Merge of sets (elem, replica, ts) with version vectors (replica, seen).

    An entry of one side stays if the other has it too, or hasn't seen it yet; of the entries
    of an element and replica the newest stays.
    """
    on = ["elem", "replica", "ts"]
    both = a.join(b, on, "left_semi")
    only_a = a.join(b, on, "left_anti").join(seen_b.select("replica", "seen"), "replica", "left").filter("seen IS NULL OR ts > seen").select(*on)
    only_b = b.join(a, on, "left_anti").join(seen_a.select("replica", "seen"), "replica", "left").filter("seen IS NULL OR ts > seen").select(*on)
    return both.select(*on).unionByName(only_a).unionByName(only_b).groupBy("elem", "replica").agg(F.max("ts").alias("ts"))
