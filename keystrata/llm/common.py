"""What the corpus operators share: tables in the shared folder, text columns, Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.scratch import discard, materialize, scratch, shared_dir
from keystrata.sources.session import ship

__all__ = ["discard", "documents", "dtype", "fresh", "map_batches", "materialize", "scratch", "shared_dir", "ship", "text_of"]


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where one of the columns has them already."""
    have = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def map_batches(df: DataFrame, fn, schema: str, rows: int = 1024) -> DataFrame:
    """mapInArrow of fn(RecordBatch) -> RecordBatch over slices of at most `rows` rows, so memory follows the slice."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                yield fn(batch.slice(a, rows))

    return df.mapInArrow(run, schema)


def dtype(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
