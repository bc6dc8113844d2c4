"""Near-duplicate classes by BagMinHash over weighted word shingles.

A document is a multiset of shingles (five consecutive words; fewer words are one shingle). For each
shingle Poisson points fill the plane of time and weight; a document sees those below its count. The
weight axis is discretised and cut hierarchically into [0,1), [1,2), [2,4), [4,8) ..., each with a
process of its own, whose points come in order of time and carry a signature position and a level: a
whole interval keeps all of its points, the topmost those below the count. A position's value is
its first point's time, so two documents agree in a position with the probability of their weighted
Jaccard similarity; and a process stops as soon as its next point is later than all positions have.

Bands of the signature gather documents in buckets. Texts of equal words are one beforehand. A bucket
never expands into pairs. Classes contract in rounds: in each, a row is held against one leader, by
exact multiset overlap, and links join classes; buckets whose rows are of one class are finished. The
first round's leader is the least of those that lead a row's buckets; later, every row that isn't of
a bucket's largest class takes a row of that class. Once fewer than a quarter of the rows that ask
find a link, rounds no longer pay: in the buckets that are left, each row outside the largest class
is held against all rows of other classes there, block by block, and only links come out. So every pair
that shares a bucket is in one class or compared, however many rounds there are. 32 bands of 5 miss a
pair of similarity 0.8 three times in a million.

Defined results: words are lower-cased runs of anything but ASCII white space; texts without words
(null, empty) are alike and form a class; a very long text is one row, whose signature and overlap see all of it;
rows that share an id are rows of their own; a null id never stays where another does; an empty table gives none.
Input columns named as result columns are dropped, others pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import discard, map_batches, materialize, ship
from keystrata.llm.components import components
from keystrata.llm.runs import Words, distinct, mix

SHINGLE, BANDS, ROWS, SIMILAR = 5, 32, 5, 0.8
#: Bytes in a block of askers or members, and what a row counts besides its text; links a round needs for each row that asked.
MEETING, ROW, PAYS = 1 << 20, 2048, 0.25
RESULT = ("class_id", "class_size", "kept")


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().split())


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document's place and hash of every shingle."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], "i8")
    w = Words(counts, np.frombuffer(b" ".join(t for t in texts if t), np.uint8))
    whole = np.flatnonzero(w.left >= width)
    hashes, docs = [w.windows(whole, width)], [w.doc[whole]]
    for n in range(1, width):
        at = w.first[counts == n]
        hashes.append(w.windows(at, n))
        docs.append(w.doc[at])
    return np.concatenate(docs), np.concatenate(hashes)


def signatures(doc: np.ndarray, shingle: np.ndarray, n: int, size: int) -> np.ndarray:
    """First times (n documents by size positions) of the multisets that the shingles form; infinite without any."""
    (doc, shingle), _, count = distinct([doc.astype(np.uint64), shingle])
    doc, count = doc.astype("i8"), count.astype("i8")
    parts = [(doc, shingle, np.zeros(len(doc), "i8"), np.ones(len(doc), "i8"), count)]  # of interval [0,1)
    low = 1
    while len(rest := np.flatnonzero(count > low)):
        parts.append((doc[rest], mix(shingle[rest] + np.uint64(low)), np.full(len(rest), low), np.full(len(rest), low), count[rest]))
        low *= 2
    doc, key, low, width, count = (np.concatenate(x) for x in zip(*parts))
    first = np.full(n * size, np.inf)
    time, drawn, block = np.zeros(len(doc)), 0, 1
    while len(doc):
        r = mix(key[:, None] + np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.cumsum(-np.log1p((r >> np.uint64(11)) * -(2.0**-53)) / width[:, None], axis=1) + time[:, None]
        s = mix(r ^ np.uint64(0xD6E8FEB86659FD93))
        spot = (s >> np.uint64(32)).astype("i8") % size + doc[:, None] * size
        level = low[:, None] + (((s & np.uint64(0xFFFFFFFF)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype("i8")
        ok = (level < count[:, None]) & (at < first[spot])
        np.minimum.at(first, spot[ok], at[ok])
        time, drawn = at[:, -1], drawn + block
        mine, back = np.unique(doc, return_inverse=True)
        late = first.reshape(n, size)[mine].max(axis=1)
        go = time < late[back]
        doc, key, low, width, count, time = (x[go] for x in (doc, key, low, width, count, time))
        block = min(64, block * 2)
    return first.reshape(n, size)


def band_keys(first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = first.astype("f4").view("u4").astype(np.uint64).reshape(len(first), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view("i8")


def overlap(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair's shingle multisets; of two without shingles 1."""
    n = len(left)
    a, x = shingles(left)
    b, y = shingles(right)
    (pair, _), back, _ = distinct([np.concatenate([a, b]).astype(np.uint64), np.concatenate([x, y])])
    ca, cb = np.bincount(back[: len(a)], minlength=len(pair)), np.bincount(back[len(a) :], minlength=len(pair))
    both = np.bincount(pair.astype("i8"), np.minimum(ca, cb), n)
    any_ = np.bincount(pair.astype("i8"), np.maximum(ca, cb), n)
    return np.where(any_ > 0, both / np.maximum(any_, 1), 1.0)


def profile(table: DataFrame, bands: int, rows: int) -> DataFrame:
    """row, words (normal text), same (128 bits of it), bands."""

    def run(batch):
        import pyarrow as pa
        import xxhash

        texts = [normal(t) for t in batch.column(1).to_pylist()]
        doc, hashes = shingles(texts)
        keys = band_keys(signatures(doc, hashes, len(texts), bands * rows), bands, rows)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype="i4"), keys.ravel())
        same = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), same, lists], names=["row", "same", "bands"])

    return map_batches(table.select("row", "text"), run, "row bigint, same binary, bands array<bigint>", rows=1024)


def verify(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap enough."""

    def run(batch):
        import pyarrow as pa

        got = overlap(*([normal(t) for t in batch.column(i).to_pylist()] for i in (2, 3)))
        return batch.select([0, 1]).filter(pa.array(got >= similar - 1e-12))

    left = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    both = left.join(texts.select(F.col("row").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    return map_batches(both.select("a", "b", "left", "right"), run, "a bigint, b bigint", rows=256)


def across(batches, similar: float):
    """Links between the askers and the members that meet them, from rows sorted by meeting: those that join classes which earlier links of the meeting didn't."""
    import pyarrow as pa

    def meet(rows: list[tuple]) -> pa.RecordBatch:
        asks = [r for r in rows if r[1]]
        members = [r for r in rows if not r[1]]
        out = []
        if asks and members:
            doc, h = shingles([normal(r[4]) for r in asks + members])
            (doc, h), _, n = distinct([doc.astype(np.uint64), h])
            doc, names = doc.astype("i8"), np.unique(h, return_inverse=True)[1]
            total = np.bincount(doc, n, len(rows))
            first = np.searchsorted(doc, np.arange(len(rows) + 1))
            k = len(asks)
            y, yn, yd = names[first[k] :], n[first[k] :], doc[first[k] :] - k
            cls = np.array([r[3] for r in members])
            held = np.zeros(int(names.max()) + 1 if len(names) else 1, n.dtype)
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := joined.get(x, x)) != x:
                    joined[x] = joined.get(up, up)
                    x = up
                return x

            for i, r in enumerate(asks):
                mine = slice(first[i], first[i + 1])
                held[names[mine]] = n[mine]
                both = np.bincount(yd, np.minimum(held[y], yn), len(members))
                held[names[mine]] = 0
                any_ = total[i] + total[k:] - both
                near = np.flatnonzero((cls != r[3]) & (both >= (similar - 1e-12) * any_))
                for j in near[np.unique(cls[near], return_index=True)[1]].tolist():
                    if (own := root(r[3])) != (other := root(members[j][3])):
                        joined[own] = other
                        out.append((r[2], members[j][2]))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][0] != r[0]:
                yield meet(rows)
                rows = []
            rows.append(r)
    if rows:
        yield meet(rows)


def missed(rows: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links among rows (bucket, row, cls) of buckets with several classes.

    Rows of a bucket's largest class need no comparison with each other. Every other row asks all
    rows of other classes. Askers and members are dealt into blocks of some MB, and each block of
    askers meets each block of members in one task. Buckets of the same rows meet once.
    """
    mark = [F.count(F.lit(1)).alias("n"), F.min("row").alias("lead"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    once = rows.groupBy("bucket").agg(*mark).groupBy("n", "lead", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    base = rows.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "cls"))["cls"].alias("base"))
    base = materialize(base.join(once, "bucket", "left_semi"), "base")
    held = materialize(rows.join(base, "bucket").join(texts.hint("merge"), "row").select("bucket", "row", "cls", (F.col("cls") != F.col("base")).alias("asks"), "text"), "mixed")
    size = F.octet_length("text") + ROW
    of = held.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("asks"), size)) / MEETING).cast("int").alias("nx"), F.ceil(F.sum(size) / MEETING).cast("int").alias("ny"))
    placed = held.join(materialize(of, "sizes"), "bucket")
    salt = lambda n: F.pmod(F.xxhash64("row"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.withColumn("y", salt("ny")).withColumn("x", every("nx")).withColumn("ask", F.lit(False))
    askers = placed.filter("asks").withColumn("x", salt("nx")).withColumn("y", every("ny")).withColumn("ask", F.lit(True))
    dealt = members.unionByName(askers).select(F.concat_ws(":", "bucket", "x", "y").alias("at"), "ask", "row", "cls", "text")
    met = dealt.repartition("at").sortWithinPartitions("at")
    ship(rows.sparkSession)
    found = materialize(met.mapInArrow(lambda batches: across(batches, similar), "a bigint, b bigint").distinct(), "found")
    discard(held)
    return found


def contracted(cls: DataFrame, found: DataFrame) -> DataFrame:
    """The classes (row, cls) after links (a, b) between rows have joined some."""
    ends = found.join(cls.select(F.col("row").alias("a"), F.col("cls").alias("x")), "a").join(cls.select(F.col("row").alias("b"), F.col("cls").alias("y")), "b")
    roots = components(ends.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = materialize(cls.join(roots.select(F.col("row").alias("cls"), "root"), "cls", "left").select("row", F.coalesce("root", "cls").alias("cls")), "classes")
    discard(roots)
    return out


def links(reps: DataFrame, table: DataFrame, similar: float) -> DataFrame | None:
    """row, root of those representatives (row, bands) that share a bucket with others; None if there are none."""
    spread = reps.select("row", F.explode("bands").alias("bucket"))
    full = materialize(spread.groupBy("bucket").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "full")
    if full.isEmpty():
        return None
    member = materialize(spread.join(full, "bucket"), "members")
    cls = materialize(member.select("row", F.col("row").alias("cls")).distinct(), "classes")
    texts = materialize(table.select("row", "text").join(cls.select("row").hint("merge"), "row"), "texts")
    pairs = member.groupBy("row").agg(F.min("lead").alias("a")).filter("row != a").select("a", F.col("row").alias("b"))
    turn, asked = 0, materialize(pairs, "asked")
    while True:
        found = materialize(verify(asked, texts, similar), "found")
        hits, asks = found.count(), asked.count()
        before, cls = cls, contracted(cls, found)
        spent, state = member, member.select("bucket", "row").join(cls, "row")
        mixed = state.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low != high").select("bucket")
        member = materialize(state.join(mixed, "bucket", "left_semi"), "members")
        for old in (before, spent, asked, found):
            discard(old)
        if member.isEmpty():
            break
        if hits < PAYS * asks:
            found = missed(member, texts, similar)
            before, cls = cls, contracted(cls, found)
            discard(before)
            break
        turn += 1
        each = member.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("n"), F.min_by("row", F.xxhash64("row", F.lit(turn))).alias("lead"))
        top = each.groupBy("bucket").agg(F.max(F.struct("n", "cls", "lead")).alias("top"))
        asks_ = member.join(top, "bucket").filter("cls != top.cls")
        pairs = asks_.groupBy("row").agg(F.min_by("top.lead", F.xxhash64("bucket", F.lit(turn))).alias("a"))
        asked = materialize(pairs.select("a", F.col("row").alias("b")), "asked")
    discard(texts)
    discard(full)
    return cls.withColumnRenamed("cls", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (or its `columns`) with class_id (its least id), class_size long, kept boolean (one row a class: the least id's)."""
    ship(docs.sparkSession)
    columns = [c for c in (columns or docs.columns) if c not in RESULT]
    own = [f"c{i}" for i in range(len(columns))]
    stored = [F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)]
    at = columns.index(text_col) if text_col in columns else None  # the text is stored once
    stored += [F.col(f"`{id_col}`").alias("id"), *([] if at is not None else [F.col(f"`{text_col}`").alias("c_text")])]
    table = materialize(docs.select(*stored).withColumn("row", F.monotonically_increasing_id()), "keyed")
    table = table.withColumn("text", F.col(own[at] if at is not None else "c_text").cast("string"))
    seen = materialize(profile(table, bands, rows), "profiles")
    reps = seen.groupBy("same").agg(F.min(F.struct("row", "bands")).alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = materialize(reps.select("same", "rep.row", "rep.bands", "n"), "reps")
    roots = links(reps.select("row", "bands"), table, similar)
    heads = reps.select("same", F.col("row").alias("rep"))
    if roots is None:
        heads = heads.withColumn("root", F.col("rep"))
    else:
        heads = heads.join(roots.withColumnRenamed("row", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    heads = materialize(heads.select("same", "root"), "heads")
    owned = materialize(table.select("row", "id").join(seen.select("row", "same").join(heads, "same").select("row", "root"), "row"), "owned")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = materialize(owned.groupBy("root").agg(least.alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    discard(seen)
    found = owned.join(classes.hint("merge"), "root").select("row", F.col("least.id").alias("class_id"), F.col("n").alias("class_size"), (F.col("row") == F.col("least.row")).alias("kept"))
    out = table.select("row", *own).join(materialize(found, "found").hint("merge"), "row")
    return out.select(*(F.col(o).alias(c) for c, o in zip(columns, own, strict=True)), *RESULT)
