"""Connected components of a link table by contraction: every round joins labels along links and keeps only links between different ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): row, root for every row in them; rows that are connected have the same root.

    In the first round each b joins the least a that it is linked to, so stars whose centre is a are done
    at once. In each further round a label joins its neighbour that is first in an order drawn for
    the round, if that is before itself; half of the labels do so on average, whatever the links
    look like (chains, stars, dense groups). Links follow their ends and repeated ones fall together,
    so their number falls with the labels: all rounds together read a few times the links.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    steps = []
    while not edges.isEmpty():
        if not steps:
            ends = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "row")
            moved = edges.groupBy(F.col("b").alias("row")).agg(F.min("a").alias("to"))
            step = ends.join(moved, "row", "left").select("row", F.coalesce("to", "row").alias("to"))
        else:
            order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = both.groupBy(F.col("a").alias("row")).agg(F.min(order("b")).alias("best"))
            step = step.select("row", F.least(F.col("best"), order("row"))["x"].alias("to"))
        step = materialize(step, "step")
        steps.append(step)
        near = edges.join(step.select(F.col("row").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("row").alias("b"), F.col("to").alias("y")), "b")
        old, edges = edges, materialize(near.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(old)
    discard(edges)
    # a round's labels are the rows of the next one: from the last round back each map takes the one behind it
    if not steps:
        return links.select(F.col("a").alias("row"), F.col("a").alias("root")).limit(0)
    out = steps.pop()
    while steps:
        last, behind = steps.pop(), out
        out = materialize(last.join(behind.select(F.col("row").alias("to"), F.col("to").alias("far")), "to", "left").select("row", F.coalesce("far", "to").alias("to")), "step")
        discard(behind)
        discard(last)
    return out.withColumnRenamed("to", "root")
