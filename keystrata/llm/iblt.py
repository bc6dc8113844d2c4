"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text falls into paragraphs (lines; a long line is cut on after words that the bytes before a space
choose, so equal passages give equal pieces wherever they stand). Each paragraph's digest goes into
three cells, one in each third of the sketch; a cell holds how many, and the XOR of their digests and
check sums. Two sketches subtract cell by cell: what both texts have cancels, and cells with a single
digest peel away until nothing is left, which gives the paragraphs that differ. If something is left
the sketch was too small, and both are made anew at twice the size. All documents of a batch are
sketched, subtracted and peeled together.

Documents are compared with the next one in falling order of their ids: texts are range-sorted once,
a task pairs neighbours as they stream by, and each partition's last document meets the first of the
next partition by a join; only the partitions' numbers meet in one task. A batch holds so many texts as a few MB
take, so memory follows the longest text.

Defined results: null text counts as empty, has no paragraphs, and is like only another empty one
(likeness 1); a very long text is one row, with as many paragraphs as it has; null ids come last, rows that share
an id are ordered by text; a table of one row is its own next; repeated paragraphs count as often as they occur; an
empty table gives none. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import dtype, map_batches, ship, text_of
from keystrata.llm.runs import distinct, mix

#: Cells in each third of the fingerprint that is returned; a line is cut after one word of CUT.
CELLS, CUT = 8, 12
#: Seed of the paragraphs' digests.
KEY = 11
_NEAR = [np.random.Generator(np.random.PCG64(100 + i)).integers(0, 2**32, 256, dtype=np.uint32) for i in range(6)]


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document's place and digest of every paragraph; the j-th equal one of a document has a digest of its own."""
    import xxhash

    body = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    spaces = np.flatnonzero(body == 32)
    begins = np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, spaces, "right")]
    spaces = spaces[spaces - begins >= len(_NEAR)]  # what stands before a text doesn't matter
    h = np.zeros(len(spaces), np.uint32)
    for i, t in enumerate(_NEAR):
        h ^= t[body[spaces - 1 - i]]
    stop = np.union1d(spaces[h % CUT == 0], np.flatnonzero(body == 10))
    start = np.concatenate([[0], stop[:-1] + 1])
    held = stop > start
    start, stop = start[held], stop[held]
    raw = body.tobytes()
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], KEY) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
    doc = np.searchsorted(ends, start, "right").astype(np.uint64)
    (doc, digest), _, n = distinct([doc, digest])
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    digest = np.repeat(digest, n)
    return np.repeat(doc, n).astype("i8"), np.where(nth > 0, mix(digest + nth.astype(np.uint64)), digest)


def cells(key: np.ndarray, size: int) -> np.ndarray:
    """A cell of each third."""
    return np.stack([(mix(key + np.uint64(i + 1)) % np.uint64(size)).astype("i8") + i * size for i in range(3)])


def check(key: np.ndarray) -> np.ndarray:
    return (mix(key ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype("u4")


class Sketches:
    """n sketches of three times `size` cells."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.count, self.keys, self.checks = np.zeros(n * 3 * size, "i4"), np.zeros(n * 3 * size, np.uint64), np.zeros(n * 3 * size, "u4")

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (cells(key, self.size) + owner * (3 * self.size)).ravel()
        np.add.at(self.count, at, np.broadcast_to(np.asarray(sign, "i4"), (3, len(key))).ravel())
        np.bitwise_xor.at(self.keys, at, np.tile(key, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(check(key), 3))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.size)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and side (1 or -1) of what the sketches hold, and which of them came out empty."""
        owners, keys, sides = [], [], []
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            one = one[check(self.keys[one]) == self.checks[one]]
            if not len(one):
                break
            at = one // (3 * self.size)
            (owner, key), back, _ = distinct([at.astype(np.uint64), self.keys[one]])
            side = np.zeros(len(key), "i4")
            side[back] = self.count[one]
            owner = owner.astype("i8")
            own = (one - at * 3 * self.size == cells(self.keys[one], self.size)[(one - at * 3 * self.size) // self.size, np.arange(len(one))])
            if not own.all():  # a check sum that fits by chance, in a cell that isn't the digest's
                good = np.zeros(len(key), bool)
                good[back[own]] = True
                owner, key, side = owner[good], key[good], side[good]
                if not len(key):
                    break
            owners.append(owner)
            keys.append(key)
            sides.append(side)
            self.add(owner, key, -side)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(owners, "i8"), cat(keys, np.uint64), cat(sides, "i4"), ~left.reshape(self.n, -1).any(axis=1)

    def strings(self) -> list[str]:
        rows = np.concatenate([x.reshape(self.n, -1).view("u1").reshape(self.n, -1) for x in (self.count, self.keys, self.checks)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def sketch(owner: np.ndarray, key: np.ndarray, n: int, size: int) -> Sketches:
    out = Sketches(n, size)
    out.add(owner, key)
    return out


def differences(owner: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For pairs of documents (places left, right of n) how many digests differ, by sketches that grow until they peel."""
    out, todo, size = np.zeros(len(left), "i8"), np.arange(len(left)), CELLS
    while len(todo):
        docs, back = np.unique(np.concatenate([left[todo], right[todo]]), return_inverse=True)
        place = np.full(n, -1)
        place[docs] = np.arange(len(docs))
        mine = place[owner] >= 0
        all_ = sketch(place[owner[mine]], key[mine], len(docs), size)
        sides = []
        for b in (back[: len(todo)], back[len(todo) :]):
            one = Sketches(len(todo), size)
            one.count, one.keys, one.checks = (x.reshape(len(docs), -1)[b].ravel() for x in (all_.count, all_.keys, all_.checks))
            sides.append(one)
        who, _, _, empty = sides[0].minus(sides[1]).peel()
        found = np.bincount(who, minlength=len(todo))
        out[todo[empty]] = found[empty]
        todo, size = todo[~empty], size * 2
    return out


def edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(texts: list[str], after: list[str]) -> list:
    """Columns n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for texts and those after them."""
    n = len(texts)
    edited = [edit(t, a).encode() for t, a in zip(texts, after, strict=True)]
    raw = [t.encode() for t in texts]
    follow = [a.encode() for a in after]
    run = n > 1 and raw[1:] == follow[:-1]  # neighbours: all but the last are there already
    every = raw + edited + (follow[-1:] if run else follow)
    owner, key = paragraphs(every)
    held = np.bincount(owner, minlength=len(every))
    i = np.arange(n)
    nxt = np.where(i < n - 1, i + 1, 2 * n) if run else 2 * n + i
    prints = sketch(owner, key, len(every), CELLS).strings()
    near = []
    for other in (n + i, nxt):
        d, both = differences(owner, key, i, other, len(every)), held[i] + held[other]
        near.append(np.where(both > 0, (both - d) / np.maximum(both + d, 1), 1.0))
    return [np.array([len(t) for t in texts], "i8"), [hashlib.sha256(e).hexdigest() for e in edited], prints[:n], prints[n : 2 * n], *near]


#: Rows and bytes of texts that are sketched together.
ROWS, BYTES = 512, 4 << 20


def runs_of(texts) -> list[tuple[int, int]]:
    """First row and number of rows of parts of an Arrow column that keep to ROWS and BYTES; a longer text is a part."""
    import pyarrow.compute as pc

    out, at, size = [], 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > at and (i - at >= ROWS or size + (n or 0) > BYTES):
            out.append((at, i - at))
            at, size = i, 0
        size += n or 0
    if len(texts) > at:
        out.append((at, len(texts) - at))
    return out


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """For each document its fingerprint and likeness (of paragraph multisets, 0 to 1) to its edited text and to the next document."""
    spark, kind = docs.sparkSession, dtype(docs, id_col)
    ship(spark)
    if spark.conf.get("spark.sql.exchange.reuse", "true") != "true":
        raise ValueError("the range sort feeds two readers, which must see the same ranges: spark.sql.exchange.reuse has to be on")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    falling = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc()]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, *falling).sortWithinPartitions(*falling, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def inner(batches):
        """All but the partition's last document, which needs the next partition's first."""
        import pyarrow as pa

        ids, texts, type_ = [], [], None
        for whole in batches:
            type_ = whole.schema.field(0).type
            for a, n in runs_of(whole.column(1)):
                ids += whole.column(0).slice(a, n).to_pylist()
                texts += whole.column(1).slice(a, n).to_pylist()
                if len(ids) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], type_), *(pa.array(c) for c in compare(texts[:-1], texts[1:]))], names=["doc_id", *NAMES])
                    ids, texts = ids[-1:], texts[-1:]

    def ends(batches):
        import pyarrow as pa

        first = last = None
        for b in batches:
            if b.num_rows:
                first = first if first is not None else b.slice(0, 1)
                last = b.slice(b.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column(2), first.column(1), last.column(0), last.column(1)], names=["part", "head", "doc_id", "text"])

    def seam(batch):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in compare(batch.column(1).to_pylist(), batch.column(2).to_pylist()))], names=["doc_id", *NAMES])

    schema = f"doc_id {kind}, {RESULT}"
    edge = ordered.mapInArrow(ends, f"part int, head string, doc_id {kind}, text string")  # a row a partition
    by = W.orderBy("part")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = ordered.select("part").distinct().select("part", F.coalesce(F.lead("part").over(by), F.first("part").over(whole)).alias("next"))
    heads = edge.select(F.col("part").alias("next"), F.col("head").alias("after"))
    pairs = edge.select("part", "doc_id", "text").join(follows, "part").join(heads, "next").select("doc_id", "text", "after")
    return ordered.mapInArrow(inner, schema).unionByName(map_batches(pairs, seam, schema))
