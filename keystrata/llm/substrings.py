"""Removal of passages that occur more than once, found by difference-cover anchors.

A window is W consecutive words of a document. Short windows of w = W - p + 1 words are hashed only
where their word's place modulo the period p lies in a difference cover of p: whatever the two places
at which W equal words start, some shift below p brings both onto the cover, so equal windows always
share an anchor. Anchors seen once rule out most windows. Those that hold a repeated anchor extend
to whole windows, which are compared by 128 bits.

Documents travel in slices (some MB of texts, zstd-compressed), so a row costs no overhead. For each
of the two hash rounds a slice sends its distinct hashes, dealt into buckets by their leading bits; a
bucket answers with one bit per hash, whether any other slice has it too, and the slice, which finds
the same hashes in the same order again, reads the answer. A hash that a third of all documents hold
costs one entry a slice. Slices go through the shared folder between rounds; nothing is collected.

Defined results: words are runs of anything but space and \\t\\n\\v\\f\\r; null text has no words; a document
shorter than a window keeps all; rows that share an id, and repeated rows, are documents of their own
(so a repeated row of W words or more repeats wholly); a very long text is a slice of its own; null ids are kept; an
empty table gives none. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import discard, dtype, map_batches, materialize, ship
from keystrata.llm.runs import Words, distinct

#: Words of a window, bytes of a slice, hashes of a bucket, and slices whose answers a task gathers.
WINDOW, SLICE, BUCKET, TOGETHER = 35, 4 << 20, 1 << 20, 32

#: A perfect difference set, every difference modulo 21 occurs in it.
COVER_21 = (3, 6, 7, 12, 14)


def cover(window: int) -> tuple[int, np.ndarray]:
    """Period and cover (a flag for each residue). Any period up to the window works; about three fifths of it serve well."""
    p = 21 if window == WINDOW else max(1, window * 3 // 5)
    flags = np.zeros(p, bool)
    if p == 21:
        flags[list(COVER_21)] = True
    else:  # the first r residues and all multiples of r
        r = math.isqrt(p - 1) + 1
        flags[:r] = True
        flags[::r] = True
    return p, flags


def pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    import pyarrow as pa

    raw = b"".join([np.array([len(arrays), *(len(a) for a in arrays), len(text)], "<i8").tobytes(), *(a.astype("<i4").tobytes() for a in arrays), text])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8)
    k = int(raw[:8].view("<i8")[0])
    sizes = raw[8 : 8 * (k + 2)].view("<i8").tolist()
    out, at = [], 8 * (k + 2)
    for n in sizes[:-1]:
        out.append(raw[at : at + 4 * n].view("<i4").astype("i8"))
        at += 4 * n
    return out, raw[at:]


def anchors(w: Words, window: int) -> np.ndarray:
    p, flags = cover(window)
    return np.flatnonzero(flags[w.place % p] & (w.left >= window - p + 1))


def edges(buckets: int) -> np.ndarray:
    """Where the buckets' ranges of leading bits begin."""
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def ballots(slice_: int, keys: list[np.ndarray], buckets: int) -> list[tuple]:
    """(bucket, slice, hashes, held twice here) of a slice."""
    u, _, n = distinct(keys)
    cuts = [*np.searchsorted(u[0], edges(buckets)).tolist(), len(u[0])]
    return [(b, slice_, np.stack([k[lo:hi] for k in u]).tobytes(), np.packbits(n[lo:hi] > 1).tobytes()) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]


def vote(df: DataFrame, columns: int, buckets: int, slices_: int) -> DataFrame:
    """From ballots: slice and its list of (bucket, bits): which of its hashes are repeated. Both shuffles have partitions as the data has buckets and slices."""
    ship(df.sparkSession)

    def count(table):
        import pyarrow as pa

        blobs = [np.frombuffer(x, np.uint64).reshape(columns, -1) for x in table.column("hashes").to_pylist()]
        sizes = [x.shape[1] for x in blobs]
        _, back, n = distinct(list(np.concatenate(blobs, axis=1)))
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(table.column("twice").to_pylist(), sizes, strict=True)])
        hit = (n[back] > 1) | (twice > 0)
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    voted = df.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, "slice bigint, bucket int, bits binary")
    return voted.repartition(slices_, "slice").groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("votes"))


def repeated(keys: list[np.ndarray], buckets: int, votes: list | None) -> np.ndarray:
    """For each of a slice's hashes, in its own order, whether it occurs again anywhere."""
    u, back, _ = distinct(keys)
    hit = np.zeros(len(u[0]), bool)
    if votes:
        cuts = [*np.searchsorted(u[0], edges(buckets)).tolist(), len(u[0])]
        for v in votes:
            lo, hi = cuts[v["bucket"]], cuts[v["bucket"] + 1]
            hit[lo:hi] = np.unpackbits(np.frombuffer(v["bits"], np.uint8), count=hi - lo)
    return hit[back]


BALLOT = "bucket int, slice bigint, hashes binary, twice binary"


def emit(df: DataFrame, keys, buckets: int) -> DataFrame:
    def run(batch):
        import pyarrow as pa

        rows = [r for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in ballots(s, keys(blob), buckets)]
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "slice", "hashes", "twice"])

    return map_batches(df.select("slice", "blob"), run, BALLOT, rows=1)


def slices(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """slice, ids, blob (word counts and texts, words joined by one space), n (its anchors)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kind, task, made = None, TaskContext.get().partitionId(), 0

        def flush(ids, counts, texts):
            nonlocal made
            w = Words(np.array(counts, "i8"), np.frombuffer(b" ".join(t for t in texts if t), np.uint8))
            blob = pack([w.counts], w.text.tobytes())
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([blob], pa.binary()), pa.array([len(anchors(w, window))], pa.int64())], names=["slice", "ids", "blob", "n"]
            )

        ids, counts, texts, size = [], [], [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for a in range(0, batch.num_rows, 512):
                for i, text in zip(batch.column(0).slice(a, 512).to_pylist(), batch.column(1).slice(a, 512).to_pylist(), strict=True):
                    words = (text or b"").split()
                    ids.append(i)
                    counts.append(len(words))
                    texts.append(b" ".join(words))
                    size += len(texts[-1]) + 16
                    if size >= SLICE:
                        yield flush(ids, counts, texts)
                        ids, counts, texts, size = [], [], [], 0
        if ids:
            yield flush(ids, counts, texts)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"slice bigint, ids array<{dtype(docs, id_col)}>, blob binary, n bigint")


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words that no repeated window covers, joined by one space)."""
    spark, kind = docs.sparkSession, dtype(docs, id_col)
    p, _ = cover(window)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(slices(docs, window, id_col, text_col), "slices")
    held, many = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets, tasks = max(least, -(-int(held) // BUCKET)), max(least, many // TOGETHER)

    def anchor_keys(blob):
        (counts,), text = unpack(blob)
        w = Words(counts, text)
        return [w.windows(anchors(w, window), window - p + 1)]

    def extend(batch):
        """Splits a slice: documents without a window in question are done, of the others these windows are noted."""
        import pyarrow as pa

        out = []
        for s, ids, blob, votes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (counts,), text = unpack(blob)
            w = Words(counts, text)
            at = anchors(w, window)
            hit = at[repeated([w.windows(at, window - p + 1)], buckets, votes)]
            mark = np.zeros(len(w.doc) + 1, "i8")
            np.add.at(mark, np.maximum(hit - p + 1, w.first[w.doc[hit]]), 1)
            np.add.at(mark, hit + 1, -1)
            asked = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (w.left >= window))
            open_ = np.zeros(len(counts), bool)
            open_[w.doc[asked]] = True
            for want in (False, True):
                docs_ = np.flatnonzero(open_ == want)
                if not len(docs_):
                    continue
                n = counts[docs_]
                held = [(w.start[w.first[d]], w.end[w.first[d] + counts[d] - 1]) for d in docs_[n > 0].tolist()]
                body = b" ".join(text[a:b].tobytes() for a, b in held)
                shift = np.zeros(len(counts), "i8")
                shift[docs_] = np.cumsum(n) - n - w.first[docs_]
                out.append((s, want, [ids[d] for d in docs_.tolist()], pack([n, asked + shift[w.doc[asked]] if want else asked[:0]], body), len(asked) * want))
        list_type = batch.schema.field(1).type
        types = (pa.int64(), pa.bool_(), list_type, pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["slice", "open", "ids", "blob", "n"])

    votes = vote(emit(made, anchor_keys, buckets), 1, buckets, tasks)
    state = f"slice bigint, open boolean, ids array<{kind}>, blob binary, n bigint"
    asked = materialize(map_batches(made.join(votes, "slice", "left").select("slice", "ids", "blob", "votes"), extend, state, rows=1), "asked")
    discard(made)
    buckets2 = max(least, -(-int(asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BUCKET))

    def window_keys(blob):
        (counts, at), text = unpack(blob)
        w = Words(counts, text)
        return [w.windows(at, window, lane) for lane in (0, 1)]

    def finish(batch):
        import pyarrow as pa

        owner, n_words, removed, kept = [], [], [], []
        for ids, blob, votes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (counts, at), text = unpack(blob)
            w = Words(counts, text)
            hit = at[repeated([w.windows(at, window, lane) for lane in (0, 1)], buckets2, votes)] if len(at) else at
            mark = np.zeros(len(w.doc) + 1, "i8")
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + window, -1)
            gone = np.cumsum(mark)[:-1] > 0
            lost = np.bincount(w.doc[gone], minlength=len(counts))
            first, n = w.first.tolist(), counts.tolist()
            raw = text.tobytes()
            for d, k in enumerate(lost.tolist()):
                if not n[d]:
                    kept.append(b"")
                elif not k:
                    kept.append(raw[w.start[first[d]] : w.end[first[d] + n[d] - 1]])
                else:
                    stay = first[d] + np.flatnonzero(~gone[first[d] : first[d] + n[d]])
                    kept.append(b" ".join([raw[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]))
            owner += ids
            n_words += n
            removed += lost.tolist()
        id_type = batch.schema.field(0).type.value_type
        return pa.RecordBatch.from_arrays([pa.array(owner, id_type), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    open_ = asked.filter("open").select("slice", "ids", "blob")
    votes2 = vote(emit(open_, window_keys, buckets2), 2, buckets2, tasks)
    no_votes = F.lit(None).cast("array<struct<bucket:int,bits:binary>>").alias("votes")
    rest = asked.filter("not open").select("ids", "blob", no_votes)
    done = open_.join(votes2, "slice", "left").select("ids", "blob", "votes").unionByName(rest)
    out = map_batches(done, finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary", rows=1)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
