"""Positions, running values and neighbours of rows in a global order, without sending all rows, or all rows of a key, to one task.

A range sort gives each partition a contiguous piece of the order, so a key that holds a third of all
rows is cut into many pieces. What a row needs from the rows before it is what its piece has before it and one
value for all earlier pieces; only those values, a row a partition, meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.sources.scratch import materialize


def pieces(df: DataFrame, by: list, partitions: int | None = None) -> DataFrame:
    """df in the order of `by`, written down, with _piece and _place (its place in the piece)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ranked")  # another job would draw other bounds
    return ordered.withColumn("_piece", F.shiftright("_id", 33).cast("int")).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def numbered(df: DataFrame, by: list, partitions: int | None = None) -> tuple[DataFrame, int]:
    """df with rank (from 0 in the order of `by`), and the number of rows."""
    ordered = pieces(df, by, partitions)
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy("_piece").count().collect())  # a row a partition
    first, total = [], 0
    for p, c in sizes:
        first.append((p, total))
        total += c
    begins = df.sparkSession.createDataFrame(first, "_piece int, _first long")
    return ordered.join(F.broadcast(begins), "_piece").withColumn("rank", F.col("_first") + F.col("_place")).drop("_piece", "_place", "_first"), total


def running(df: DataFrame, by: list, values: dict[str, tuple[Callable, Column]], inclusive: bool = True, after: dict[str, tuple[Callable, Column]] | None = None, partitions: int | None = None) -> DataFrame:
    """df with, under each name, an aggregate (F.sum, F.max, F.min) of a column over all rows up to this one, or before it; `after`: over all rows behind it.

    With the key first in `by`, the greatest struct(key, x) so far is the greatest x of this key, as
    soon as the key has one; so running values of keys, and neighbours, are of this form too.
    """
    back, values = set(after or ()), values | (after or {})
    named = {n: f"_v{i}" for i, n in enumerate(values)}
    ordered = pieces(df.withColumns({named[n]: c for n, (_, c) in values.items()}), by, partitions)
    whole = ordered.groupBy("_piece").agg(*(f(named[n]).alias(f"{named[n]}_all") for n, (f, _) in values.items()))
    order = lambda n, c: F.desc(c) if n in back else F.asc(c)
    others = lambda n: W.orderBy(order(n, "_piece")).rowsBetween(W.unboundedPreceding, -1)  # noqa: E731  a row a partition
    carried = whole.select("_piece", *(f(f"{named[n]}_all").over(others(n)).alias(f"{named[n]}_all") for n, (f, _) in values.items()))
    inside = lambda n: W.partitionBy("_piece").orderBy(order(n, "_place")).rowsBetween(W.unboundedPreceding, 0 if inclusive and n not in back else -1)
    out = ordered.withColumns({f"{named[n]}_in": f(named[n]).over(inside(n)) for n, (f, _) in values.items()}).join(F.broadcast(carried), "_piece", "left")
    both = {}
    for n, (f, _) in values.items():
        a, b = F.col(f"{named[n]}_all"), F.col(f"{named[n]}_in")
        if f is F.sum:
            both[n] = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            both[n] = F.when(a.isNull(), b).when(b.isNull(), a).when((a >= b) if f is F.max else (a <= b), a).otherwise(b)
    return out.select(*df.columns, *(c.alias(n) for n, c in both.items()))


def of_key(column: str, key: str | list[str], field: str) -> Column:
    """The field of a running struct that begins with the key, if it is this row's key's."""
    same = F.lit(True)
    for k in [key] if isinstance(key, str) else key:
        same = same & F.col(column)[k].eqNullSafe(F.col(k))
    return F.when(F.col(column).isNotNull() & same, F.col(column)[field])


def within(df: DataFrame, key: list[str], by: list, name: str) -> DataFrame:
    """df with the place (from 1) of each row among its key's, in the order of `by`."""
    rows, _ = numbered(df, [*key, *by])
    first = rows.groupBy(*key).agg(F.min("rank").alias("_first"))
    return rows.join(first, key).withColumn(name, F.col("rank") - F.col("_first") + 1).drop("rank", "_first")


def median(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """The exact median of each key's values: the middle places of a global order."""
    rows, _ = numbered(df.select(*key, F.col(value).alias("_x")).filter(F.col("_x").isNotNull()), [*key, "_x"])
    ends = rows.groupBy(*key).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    at = F.col("rank") - F.col("_first")
    middle = (2 * at == F.col("_n") - 1) | (2 * at == F.col("_n") - 2) | (2 * at == F.col("_n"))
    return rows.join(ends, key).filter(middle).groupBy(*key).agg(F.avg("_x").alias(name))
