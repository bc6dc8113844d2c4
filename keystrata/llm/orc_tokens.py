"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on the document id.

write_tokens() range-sorts raw texts by id, encodes each partition as it is written, and leaves one
file (with many stripes) a partition; files, stripes and row groups thereby hold narrow id ranges,
so min/max and Bloom metadata prune point and range reads, and stripes are read in parallel.
Only texts are shuffled (ids are larger), and sampling for the ranges never runs the tokenizer.

Defined results: null text counts as empty (only the end id is written); rows with a null id come
first; rows that share an id keep an order by text; repeated rows are written repeatedly; a very long text is one
row of a file; an empty table gives files without rows. Further columns, whatever their names, are not written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.bpe import encoder
from keystrata.llm.common import dtype, map_batches, text_of


def _schema(kind: str) -> str:
    return f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the ids of every text, end_id after each, under `out` in ascending id order; returns the files as a DataFrame."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", F.spark_partition_id().alias("part"), "text")

    def run(batches):
        import pyarrow as pa

        e, done = encoder(path), 0
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                flat, ends = e.encode(batch.column(2), end_id)
                ids = pa.ListArray.from_arrays(ends.astype("i4"), flat.view("i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends[:-1] + done), pa.array(np.diff(ends)), ids], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                done += int(ends[-1])

    from keystrata.llm.common import ship

    ship(spark)
    kind = dtype(docs, id_col)
    (
        ordered.mapInArrow(run, _schema(kind))
        .write.option("compression", "none").option("orc.stripe.size", str(16 << 20)).option("orc.row.index.stride", "2000")
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )
    return read_tokens(spark, out, kind)


def read_tokens(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """The files' rows; a filter on doc_id is pushed to their indexes and Bloom filters."""
    return spark.read.schema(_schema(kind)).orc(out)


def with_start(tokens: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before one. Files' totals are summed; rows only add their file's.

    The totals have a row a file, and write_tokens() makes a file a partition: small enough to broadcast at any size.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def with_crc(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replaces the ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != ids_col]

    def run(batch):
        import zlib

        import pyarrow as pa

        ids = batch.column(len(keep))
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = [0, *np.cumsum(np.diff(ids.offsets.to_numpy())).tolist()]
        crc = pa.array([zlib.crc32(flat[a:b].data) for a, b in zip(ends, ends[1:])], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], crc], names=[*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {dtype(rows, c)}" for c in keep)
    return map_batches(rows.select(*keep, ids_col), run, f"{schema}, ids_crc32 bigint", rows=2048)
