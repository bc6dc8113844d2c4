"""Interval algebra on a ring of keys: membership, unions by gaps and islands, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.ranks import of_key, running

#: An open end.
ALL = None


@dataclass(frozen=True)
class Interval:
    """From lo to hi; open ends are None, lo above hi wraps around."""

    lo: float | None
    hi: float | None
    lo_in: bool = True
    hi_in: bool = True

    @property
    def empty(self) -> bool:
        """(a,a), [a,a) and (a,a] hold nothing; [a,a] holds one key."""
        return self.lo is not None and self.lo == self.hi and not (self.lo_in and self.hi_in)

    def test(self, key: Column) -> Column:
        if self.empty:
            return F.lit(False)
        above = F.lit(True) if self.lo is None else (key >= self.lo if self.lo_in else key > self.lo)
        below = F.lit(True) if self.hi is None else (key <= self.hi if self.hi_in else key < self.hi)
        wraps = self.lo is not None and self.hi is not None and self.lo > self.hi
        return above | below if wraps else above & below


def member(key: Column, pieces: list[Interval]) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | p.test(key)
    return out


def union(df: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Union of closed intervals of each group, pieces that touch joined: a new island begins where nothing before reaches.

    Islands follow from running values in the order of lower ends, so a group may hold any share of the rows.
    """
    rows = df.select(*group, lo, hi)
    swept = running(rows, [*group, lo, hi], {"_reach": (F.max, F.struct(*group, F.col(hi).alias("_h")))}, inclusive=False)
    reach = of_key("_reach", group, "_h")
    begins = swept.filter(reach.isNull() | (F.col(lo) > reach)).select(*group, F.col(lo), reach.alias("_before"))
    # an island ends where the next one found everything before it to end, the last at the group's end
    nxt = running(begins, [*group, lo], {}, after={"_next": (F.min, F.struct(*group, F.col(lo).alias("_l"), F.col("_before").alias("_h")))})
    ends = rows.groupBy(*group).agg(F.max(hi).alias("_end"))
    return nxt.join(ends, group).select(*group, lo, F.coalesce(of_key("_next", group, "_h"), F.col("_end")).alias(hi))


def events(a: DataFrame, b: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Where intervals of either set begin (_end 0) and end (_end 1): group, _at, _end, _a, _b (1, -1 or 0)."""
    out = None
    for df, side in ((a, "_a"), (b, "_b")):
        for at, end in ((lo, 0), (hi, 1)):
            step = 1 - 2 * end
            one = df.select(*group, F.col(at).alias("_at"), F.lit(end).alias("_end"), *(F.lit(step if side == c else 0).alias(c) for c in ("_a", "_b")))
            out = one if out is None else out.unionByName(one)
    return out


def intersection(a: DataFrame, b: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Common pieces of two sets of closed intervals, each as union() gives them, by group.

    One sweep over ends counts what covers a place; as every group's counts come back to 0, the counts of all groups
    before add nothing. A piece begins where the second set joins the first, and the next event ends it.
    """
    by = [*group, "_at", "_end"]
    swept = running(events(a, b, group, lo, hi), by, {"_na": (F.sum, F.col("_a")), "_nb": (F.sum, F.col("_b"))}, after={"_next": (F.min, F.struct(*by))})
    both = swept.filter("_end = 0 AND _na > 0 AND _nb > 0")
    return both.select(*group, F.col("_at").alias(lo), of_key("_next", group, "_at").alias(hi))


def difference(a: DataFrame, b: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Half-open intervals [lo, hi) of a without those of b: sweep over ends with running cover counts."""
    points = events(a, b, group, lo, hi).groupBy(*group, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    swept = running(points, [*group, "_at"], {"_na": (F.sum, F.col("_a")), "_nb": (F.sum, F.col("_b"))}, after={"_next": (F.min, F.struct(*group, "_at"))})
    pieces = swept.filter("_na > 0 AND _nb = 0").select(*group, F.col("_at").alias(lo), of_key("_next", group, "_at").alias(hi)).filter(F.col(hi).isNotNull())
    return union(pieces, group, lo, hi)


def relations(a: DataFrame, b: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Each interval of a with subset, adjacent, left_of: whether that holds for some interval of b in its group.

    A sweep by lower ends carries how far b reaches, and ends that touch meet by equality: rows are those of a and b, never pairs.
    """
    one = a.select(*group, lo, hi, F.lit(1).alias("_a")).unionByName(b.select(*group, lo, hi, F.lit(0).alias("_a")))
    far = F.when(F.col("_a") == 0, F.struct(*group, F.col(hi).alias("_h")))
    swept = running(one, [*group, lo, "_a"], {"_r": (F.max, far)}).filter("_a = 1").withColumn("_reach", of_key("_r", group, "_h")).drop("_r")
    last = b.groupBy(*group).agg(F.max(lo).alias("_last"))
    begins = b.select(*group, F.col(lo).alias(hi), F.lit(True).alias("_begins")).distinct()
    ends = b.select(*group, F.col(hi).alias(lo), F.lit(True).alias("_ends")).distinct()
    met = swept.join(last, group, "left").join(begins, [*group, hi], "left").join(ends, [*group, lo], "left")
    no = F.lit(False)
    subset, left_of = F.coalesce(F.col("_reach") >= F.col(hi), no), F.coalesce(F.col("_last") > F.col(hi), no)
    return met.select(*group, lo, hi, subset.alias("subset"), F.coalesce("_begins", "_ends", no).alias("adjacent"), left_of.alias("left_of"))


def bucket(key: Column, lo: float, hi: float, n: int) -> Column:
    """Which of n equal parts of [lo, hi) a key is in, from 1."""
    return F.width_bucket(key.cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(n))


def split(lo: int, hi: int, n: int) -> list[Interval]:
    """n neighbouring parts of [lo, hi), whole numbers at the cuts."""
    cuts = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return [Interval(a, b, True, False) for a, b in zip(cuts, cuts[1:]) if a < b]
