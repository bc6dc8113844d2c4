"""Time-slot series: slots, gauge, counter, event and timing values, gaps, retention, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.operators.ranks import of_key, running


def slot_of(ts: str, length: str, origin: str | None = None) -> Column:
    """Start of a timestamp's slot; the first slot begins at the origin (the epoch unless given)."""
    return F.window(ts, length, length, origin)["start"] if origin else F.window(ts, length)["start"]


def gauge(value: str, *arrival: str) -> Column:
    """The value that arrived last."""
    return F.max_by(value, F.struct(*arrival))


def counter(value: str) -> Column:
    return F.sum(value)


def event(ts: str, value: str) -> Column:
    """All values with their times, in order: as long as a slot's rows, so slots should be short."""
    return F.sort_array(F.collect_list(F.struct(ts, value)))


def timing(value: str) -> list[Column]:
    x = F.col(value)
    return [F.sum(x).alias("sum"), F.sum(x * x).alias("sum2"), F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most")]


def combine_timing() -> list[Column]:
    """Timing slots into longer ones: the partials are mergeable."""
    return [F.sum("sum").alias("sum"), F.sum("sum2").alias("sum2"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]


def deviation(total: str = "sum", squares: str = "sum2", n: str = "n") -> Column:
    """Population deviation from the sums."""
    mean = F.col(total) / F.col(n)
    return F.sqrt(F.greatest(F.col(squares) / F.col(n) - mean * mean, F.lit(0.0)))


def custom(df: DataFrame, slot: Column, parts: dict[str, Column], finish: Callable[[dict[str, Column]], Column], name: str) -> DataFrame:
    """Slots with a function of one's own: mergeable aggregates, and what becomes of them."""
    return df.groupBy(slot.alias("slot")).agg(*(c.alias(f"_{n}") for n, c in parts.items())).select("slot", finish({n: F.col(f"_{n}") for n in parts}).alias(name))


def retained(df: DataFrame, group: list[str], slot: str, length_s: int, count: int) -> DataFrame:
    """Slots that a ring buffer of `count` slots still holds: those after the newest less its span."""
    newest = df.groupBy(*group).agg(F.max(slot).alias("_newest"))
    return df.join(newest, group).filter(F.col(slot) > F.col("_newest") - F.expr(f"INTERVAL {length_s * count} SECONDS")).drop("_newest")


def fill(df: DataFrame, group: list[str], slot: str, values: list[str], length: str, policy: str = "undefined") -> DataFrame:
    """Every slot between a group's first and last: missing ones undefined, zero, or as the last one before."""
    ends = df.groupBy(*group).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
    grid = ends.select(*group, F.explode(F.expr(f"sequence(_lo, _hi, INTERVAL {length})")).alias(slot))
    out = grid.join(df.select(*group, slot, *values), [*group, slot], "left")
    if policy == "zero":
        return out.fillna(0, subset=values)
    if policy == "last":
        by = W.partitionBy(*group).orderBy(slot).rowsBetween(W.unboundedPreceding, 0)
        return out.withColumns({v: F.last(v, True).over(by) for v in values})
    return out


def merge(first: DataFrame, second: DataFrame, group: list[str], slot: str, value: str, kind: str) -> DataFrame:
    """Two series of a kind: counters add; of gauges the first one's value stays where it has one."""
    if kind == "counter":
        return first.unionByName(second).groupBy(*group, slot).agg(F.sum(value).alias(value))
    ranked = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return ranked.groupBy(*group, slot).agg(F.min_by(value, "_p").alias(value))


def in_time(df: DataFrame, group: list[str], slot: Column, arrival: list[str]) -> DataFrame:
    """Without late rows: those whose slot is before the newest slot that arrived earlier."""
    rows = df.withColumn("_slot", slot)
    seen = running(rows, [*group, *arrival], {"_newest": (F.max, F.struct(*group, "_slot"))})
    return seen.filter(F.col("_slot") == of_key("_newest", group, "_slot")).drop("_slot", "_newest")
