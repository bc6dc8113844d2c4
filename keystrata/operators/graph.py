"""Closures over link tables by a frontier that grows in rounds, each written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import materialize

#: Rounds whose frontiers may stand beside the table of what was seen.
ROUNDS = 8


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, level: everything that start (node) reaches over edges (src, dst), with the fewest steps; cycles end by themselves.

    A round reads the frontier and one table of what was seen. That table is written anew whenever the
    rounds since have added as much as it holds, so it is read and written a bounded number of times its size.
    """
    seen = materialize(start.select("node").distinct().withColumn("level", F.lit(0)), "closure")
    frontier, recent, level, held, added = seen, [], 0, seen.count(), 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        step = step.join(seen.select("node"), "node", "left_anti")
        for r in recent:
            step = step.join(r.select("node"), "node", "left_anti")
        frontier = materialize(step.withColumn("level", F.lit(level)), "closure")
        n = frontier.count()
        if not n:
            break
        recent.append(frontier)
        added += n
        if added >= held or len(recent) >= ROUNDS:
            seen = materialize(reduce(DataFrame.unionByName, recent, seen), "closure")
            recent, held, added = [], held + added, 0
    return reduce(DataFrame.unionByName, recent, seen)
