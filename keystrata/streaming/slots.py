"""Time-slot series as Structured Streaming queries.

A slot aggregate is the same column list in batch and stream. Where the engine's watermark is too
lenient (it drops rows behind earlier batches' maximum only), drop_late() keeps each key's newest slot
as state and drops what is behind it, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.scratch import scratch


def replayed(df: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """A table as a stream of files in the order of a column, one file a batch."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "replay")
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    at = F.col(order)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        piece = (F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi)
        df.filter(piece).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is; its last complete result, or all that it appended or updated."""
    spark = SparkSession.active()
    out = scratch(spark, "stream")

    def sink(batch: DataFrame, i: int) -> None:
        # a batch that is tried again replaces what it wrote before
        batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={i}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def timing(stream: DataFrame, ts: str, value: str, length: str, columns: Callable) -> DataFrame:
    """Slot aggregates of a stream."""
    return stream.groupBy(F.window(ts, length)["start"].alias("slot")).agg(*columns(value))


def drop_late(stream: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """Rows whose slot isn't before the newest slot of their key that arrived earlier."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(order)
        slot = (rows[ts].astype("datetime64[us]").astype("int64") // (seconds * 1_000_000)).to_numpy()
        seen = pd.Series(slot).cummax().clip(lower=newest).to_numpy()
        state.update((int(seen[-1]),))
        yield rows[slot == seen]

    return stream.groupBy(key).applyInPandasWithState(keep, schema, "newest long", "append", "NoTimeout")


def change_feed(stream: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Newest state of each key: a mergeable aggregate, so that only the state's rows are kept."""
    return stream.groupBy(key).agg(F.max_by(F.struct(version, *columns), version).alias("_v")).select(key, "_v.*")


def alarms(stream: DataFrame, ts: str, value: str, length: str, low: float, high: float) -> DataFrame:
    """-1, 0 or 1 for each slot: its average is below, between or above the bounds."""
    v = F.avg(value)
    return stream.groupBy(F.window(ts, length)["start"].alias("slot")).agg(F.when(v < low, -1).when(v > high, 1).otherwise(0).alias("step"))
