"""A small object query: filter, subquery, order, range and result over a class's table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ObjectQuery:
    """Steps return new queries; nothing runs before result(). A predicate that is null counts as false."""

    rows: DataFrame

    def where(self, predicate: Column | str) -> ObjectQuery:
        return ObjectQuery(self.rows.filter(predicate))

    def is_in(self, column: str, sub: DataFrame, name: str) -> ObjectQuery:
        return ObjectQuery(self.rows.join(sub.select(F.col(name).alias("_s")), F.col(column) == F.col("_s"), "left_semi"))

    def not_in(self, column: str, sub: DataFrame, name: str) -> ObjectQuery:
        return ObjectQuery(self.rows.join(sub.select(F.col(name).alias("_s")), F.col(column) == F.col("_s"), "left_anti"))

    def against(self, column: str, sub: DataFrame, compare) -> ObjectQuery:
        """Compare with a subquery of one row and column (a scalar, one row to each task); none compares as null, several are an error."""
        x = F.col(sub.columns[0])
        several = F.raise_error(F.lit("the subquery has several rows")).cast(sub.schema[0].dataType)
        one = sub.agg(F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first(x)).alias("_one"))
        return ObjectQuery(self.rows.join(F.broadcast(one), compare(F.col(column), F.col("_one")), "inner").drop("_one"))

    def order(self, *by: Column | str) -> ObjectQuery:
        return ObjectQuery(self.rows.orderBy(*by))

    def range(self, first: int, stop: int) -> ObjectQuery:
        return ObjectQuery(self.rows.offset(first).limit(stop - first))

    def result(self, *columns: Column | str) -> DataFrame:
        return self.rows.select(*columns) if columns else self.rows


def violations(df: DataFrame, column: str) -> DataFrame:
    """Values that break uniqueness, and how often they occur."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cascade(root: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Rows that a deletion takes along: chain has (table, foreign key, own key), each pointing at the one before."""
    out, keys = [], root
    for df, foreign, own in chain:
        gone = df.join(keys.select(F.col(keys.columns[0]).alias("_k")).distinct(), F.col(foreign) == F.col("_k"), "left_semi")
        out.append(gone)
        keys = gone.select(own)
    return out
