"""Best-fit packing of documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Pieces are range-sorted by falling length, which gives each a rank. Pieces of one length, and gaps
of one size, are interchangeable, so a superstep treats them as runs: it takes the runs of gaps in
rising order, gives the smallest that fit (the successors of the length) to the longest pieces not
yet placed, settles who gets which gap by rank (the i-th piece of the run goes to the i-th gap),
updates the gaps' sizes and repeats with the next length. As lengths are at most the capacity there
are at most that many runs of either kind: the driver sees a histogram and keeps runs, whose number
is bounded by the capacity whatever the input; executors look their pieces' ranks up in the result.

Defined results: null text counts as empty (a piece of the end id alone); a document longer than
the capacity is cut into pieces of the capacity and a rest; rows that share an id are packed each;
null ids are kept; a very long text is encoded as one row; an empty table gives no pieces. Further columns, whatever
their names, play no part.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.bpe import encoder
from keystrata.llm.common import dtype, map_batches, materialize, text_of

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces."""

    def run(batch):
        import pyarrow as pa

        flat, at = encoder(path).encode(batch.column(1), end_id)
        size = np.diff(at)
        n = -(-size // capacity)
        owner = np.repeat(np.arange(len(size)), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[owner] - start, capacity)
        first = at[owner] + start
        crc = [zlib.crc32(flat[a:b].data) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(owner)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if keep_ids:  # pieces follow each other without a gap
            columns.append(pa.ListArray.from_arrays(np.append(first, at[-1]).astype("i4"), flat.view("i4")))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = f"doc_id {dtype(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return map_batches(docs.select(id_col, text_of(text_col).alias("text")), run, schema)


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (first rank, length, pieces a sequence, first sequence, used before) that place counts[length] pieces of each length.

    A step halves a gap at least, and a length opens three runs at most, so runs stay under a few
    tens of thousands for a capacity of 2048.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: (first sequence, how many)
    sizes: list[int] = []  # of gaps, rising
    out, rank, sequences = [], 0, 0

    def open_gap(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    def place(first: int, n: int, size: int, length: int, left: int) -> int:
        """left pieces into n gaps of a size from a first sequence on, each filled before the next; what is left then."""
        nonlocal rank
        each = size // length
        full = min(n, left // each)
        if full:
            out.append((rank, length, each, first, capacity - size))
            open_gap(size - each * length, first, full)
            rank += full * each
            left -= full * each
        if full < n and left:
            out.append((rank, length, each, first + full, capacity - size))
            open_gap(size - left * length, first + full, 1)
            rank += left
            left, full = 0, full + 1
        open_gap(size, first + full, n - full)
        return left

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            size = sizes.pop(at)
            for first, n in gaps.pop(size):
                if left:
                    left = place(first, n, size, length, left)
                else:
                    open_gap(size, first, n)
        if left:
            n = -(-left // (capacity // length))
            place(sequences, n, capacity, length, left)
            sequences += n
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset: their place in sequences of at most `capacity` ids, gapless from 0."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, path, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    falling = [F.col("length").desc(), F.col("doc_id").asc(), F.col("start").asc(), F.col("ids_crc32").asc()]
    ordered = materialize(made.repartitionByRange(n, *falling).sortWithinPartitions(*falling).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    seen = ordered.groupBy(part.alias("part")).count().collect()  # a row a partition
    counts = {int(r[0]): int(r[1]) for r in ordered.groupBy("length").count().collect()}  # capacity rows at most
    base, total = {}, 0
    for p, c in sorted((int(r[0]), int(r[1])) for r in seen):
        base[p], total = total, total + c
    runs = np.array(supersteps(counts, capacity) or [(0, 1, 1, 0, 0)], "i8").T
    names = [c for c in ordered.columns if c != "at"]

    def run(batch):
        import pyarrow as pa

        at = batch.column(len(names)).to_numpy()
        rank = np.array([base[p] for p in (at >> 33).tolist()], "i8") + (at & ((1 << 33) - 1))
        first, length, each, sequence, used = runs[:, np.searchsorted(runs[0], rank, "right") - 1]
        nth = rank - first
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence + nth // each), pa.array(used + nth % each * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {dtype(ordered, c)}" for c in names)
    return map_batches(ordered.select(*names, "at"), run, f"{schema}, sequence_id bigint, offset bigint", rows=8192)
