"""Bloom, counting Bloom and invertible sketches, Merkle levels and bounded histograms as table operations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """Bits and hash functions for n elements and a false-positive rate."""
    m = max(64, math.ceil(-max(n, 1) * math.log(fpr) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def fpr(m: int, k: int, n: int) -> float:
    return (1 - math.exp(-k * n / m)) ** k


def hashes(x: Column, n: int, rule: str = "xxhash64") -> list[Column]:
    """n (four at most) whole numbers from 0 on that a value hashes to; md5: eight hexadecimal digits each of its text's digest."""
    if rule == "md5":
        h = F.md5(x.cast("string").cast("binary"))
        return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]
    return [F.xxhash64(x, F.lit(i)).bitwiseAND(F.lit((1 << 63) - 1)) for i in range(n)]


def positions(x: Column, m: int, k: int, rule: str = "xxhash64") -> Column:
    """k places below m of an element, by double hashing."""
    a, b = hashes(x, 2, rule)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(a % m + i * (b % (m - 1) + 1), F.lit(m)))


#: Bits of a block of a Bloom filter: eight words.
BITS = 512


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter as a table, a row a block: block, w0 to w7. An element's bits are all in one block, so a
    lookup is one row of a join, a filter grows with its elements, and none of it passes through the driver."""

    table: DataFrame
    blocks: int
    k: int
    rule: str

    def bits(self, x: Column) -> tuple[Column, Column]:
        """Block and places in it."""
        a, b, c = hashes(x, 3, self.rule)
        return a % self.blocks, F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: ((b + i * (c % (BITS - 1) + 1)) % BITS).cast("int"))

    def union(self, other: Bloom) -> Bloom:
        if (self.blocks, self.k, self.rule) != (other.blocks, other.k, other.rule):
            raise ValueError("filters of different shape")
        both = self.table.unionByName(other.table).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BITS // 64)))
        return Bloom(both, self.blocks, self.k, self.rule)

    def mark(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with a column that says whether the filter may hold a row's element; null is never held."""
        block, places = self.bits(F.col(column))
        words = F.array(*(F.col(f"_w{i}") for i in range(BITS // 64)))
        held = self.table.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(BITS // 64)))
        asked = df.withColumns({"_block": block, "_places": places}).join(held, "_block", "left")
        one = lambda p: F.call_function("shiftright", F.get(words, F.floor(p / 64).cast("int")), p % 64).bitwiseAND(F.lit(1).cast("long")) == 1
        return asked.withColumn(name, F.coalesce(F.col("_w0").isNotNull() & F.forall("_places", one), F.lit(False))).select(*df.columns, name)


def bloom_of(df: DataFrame, column: str, n: int, rate: float, rule: str = "xxhash64") -> Bloom:
    """A filter of a column's elements, for n of them and a rate of false positives (blocks make it somewhat higher)."""
    m, _ = bloom_size(n, rate)
    empty = Bloom(df, max(1, -(-m // BITS)), max(1, round(-math.log2(rate))), rule)
    block, places = empty.bits(F.col(column))
    word = lambda i: F.aggregate(
        F.filter("_places", lambda p: F.floor(p / 64) == i), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64))
    )
    spread = df.filter(F.col(column).isNotNull()).select(block.alias("block"), places.alias("_places"))
    table = spread.groupBy("block").agg(*(F.bit_or(word(i)).alias(f"w{i}") for i in range(BITS // 64)))
    return Bloom(table, empty.blocks, empty.k, rule)


def counting_bloom(df: DataFrame, column: str, m: int, k: int, sign: Column | int = 1, rule: str = "xxhash64") -> DataFrame:
    """pos, n: how many elements (added less removed) hash there."""
    step = sign if isinstance(sign, Column) else F.lit(sign)
    spread = df.select(F.explode(positions(F.col(column), m, k, rule)).alias("pos"), step.alias("s"))
    return spread.groupBy("pos").agg(F.sum("s").alias("n")).filter("n <> 0")


def iblt(df: DataFrame, column: str, size: int, k: int = 3) -> DataFrame:
    """third, cell, n, keys, checks of an invertible sketch of a long column."""
    x = F.col(column).cast("long")
    cells = F.array(*(F.struct(F.lit(i).alias("third"), F.pmod(F.xxhash64(x, F.lit(i)), F.lit(size)).alias("cell")) for i in range(k)))
    spread = df.select(x.alias("x"), F.explode(cells).alias("c"))
    return spread.groupBy("c.third", "c.cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("keys"), F.bit_xor(F.xxhash64("x", F.lit(99))).alias("checks"))


def iblt_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    neg = b.select("third", "cell", (-F.col("n")).alias("n"), "keys", "checks")
    both = a.unionByName(neg).groupBy("third", "cell").agg(F.sum("n").alias("n"), F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks"))
    return both.filter("n <> 0 OR keys <> 0 OR checks <> 0")


def iblt_entries(cells: DataFrame, size: int, k: int = 3) -> tuple[DataFrame, bool]:
    """x, side of what the cells hold, and whether they came out empty; each round takes the pure cells' keys out, until none is pure."""
    from keystrata.sources.scratch import materialize

    found, rest = None, materialize(cells, "cells")
    while True:
        pure = rest.filter((F.abs("n") == 1) & (F.xxhash64("keys", F.lit(99)) == F.col("checks"))).select(F.col("keys").alias("x"), F.col("n").alias("side")).distinct()
        pure = materialize(pure, "pure")
        if pure.isEmpty():
            break
        found = pure if found is None else found.unionByName(pure)
        cells_ = F.array(*(F.struct(F.lit(i).alias("third"), F.pmod(F.xxhash64("x", F.lit(i)), F.lit(size)).alias("cell")) for i in range(k)))
        out = pure.select("x", "side", F.explode(cells_).alias("c")).select("c.third", "c.cell", F.col("side").alias("n"), F.col("x").alias("keys"), F.xxhash64("x", F.lit(99)).alias("checks"))
        taken = out.groupBy("third", "cell").agg(F.sum("n").alias("n"), F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks"))
        rest = materialize(iblt_minus(rest, taken), "cells")
    empty = rest.isEmpty()
    return (found if found is not None else cells.select(F.col("keys").alias("x"), F.col("n").alias("side")).limit(0)), empty


def iblt_difference(a: DataFrame, b: DataFrame, column: str, size: int) -> DataFrame:
    """x, side (1: only in a, -1: only in b) of two columns of distinct numbers, from sketches that grow until what is left of them peels away.

    How many of a sketch's cells are left tells how many numbers differ, so a sketch that is too small is
    seldom peeled: the next one is made for that number, or is eight times as large where every cell is taken.
    """
    from keystrata.sources.scratch import materialize

    while True:
        cells = materialize(iblt_minus(iblt(a, column, size), iblt(b, column, size)), "cells")
        taken = cells.count() / (3 * size)
        if taken > 0.98:
            size *= 8
            continue
        need = math.ceil(-size * math.log(1 - taken))  # three cells a number peel in a few rounds
        if need <= size:
            found, empty = iblt_entries(cells, size)
            if empty:
                return found
        size = max(2 * size, need)


def merkle_levels(df: DataFrame, key: str, version: str, lo: int, hi: int, fan: int, depth: int) -> list[DataFrame]:
    """Levels from the leaves up: bucket, hash, n. Equal intervals with equal hashes hold equal entries."""
    leaves = fan**depth
    place = F.floor((F.col(key) - lo) * leaves / (hi - lo)).cast("long")
    level = df.select(place.alias("bucket"), F.xxhash64(key, version).alias("h")).groupBy("bucket").agg(F.bit_xor("h").alias("hash"), F.count(F.lit(1)).alias("n"))
    return [level, *merkle_up(level, fan, depth)]


def merkle_up(level: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """The levels above a level."""
    out = []
    for _ in range(depth):
        level = level.groupBy(F.floor(F.col("bucket") / fan).cast("long").alias("bucket")).agg(F.bit_xor(F.xxhash64("bucket", "hash")).alias("hash"), F.sum("n").alias("n"))
        out.append(level)
    return out


def closest_merged(h: str, size: int, whole: bool = False) -> str:
    """SQL: a sorted array of (x, n), with its two closest neighbours (the first such pair) made one at their weighted mean if it is over size."""
    gap = f"transform(sequence(1, size({h}) - 1), j -> get({h}, j).x - get({h}, j - 1).x)"
    left, right = f"get({h}, i - 1)", f"get({h}, i)"
    total = f"({left}.x * {left}.n + {right}.x * {right}.n)"
    mean = f"{total} div ({left}.n + {right}.n)" if whole else f"{total} / ({left}.n + {right}.n)"
    one = f"named_struct('x', {mean}, 'n', {left}.n + {right}.n)"
    fewer = f"concat(slice({h}, 1, i - 1), array({one}), slice({h}, i + 2, size({h})))"
    bound = f"get(transform(array(CAST(array_position(g, array_min(g)) AS int)), i -> {fewer}), 0)"
    return f"CASE WHEN size({h}) > {size} THEN get(transform(array({gap}), g -> {bound}), 0) ELSE {h} END"


def histogram_type(whole: bool) -> str:
    return f"array<struct<x:{'bigint' if whole else 'double'},n:bigint>>"


def inserted(entries: str, size: int, whole: bool = False, start: str | None = None) -> str:
    """SQL: a bounded histogram (from `start`, else empty) after an array of (x, n), one entry after the other; size 0 keeps nothing."""
    none = f"CAST(array() AS {histogram_type(whole)})"
    if size == 0:
        return none
    # a new entry stands before equal ones
    more = "concat(filter(acc, v -> v.x < e.x), array(e), filter(acc, v -> v.x >= e.x))"
    return f"aggregate({entries}, {start or none}, (acc, e) -> get(transform(array({more}), h -> {closest_merged('h', size, whole)}), 0))"


def merged(histograms: str, size: int, whole: bool = False) -> str:
    """SQL: an array of bounded histograms as one: each is added whole, then the closest neighbours merge until the size is kept."""
    none = f"CAST(array() AS {histogram_type(whole)})"
    shrink = f"aggregate(sequence(1, size(s)), s, (acc, _) -> {closest_merged('acc', size, whole)})"
    return f"aggregate({histograms}, {none}, (all_, h) -> get(transform(array(array_sort(concat(all_, h))), s -> CASE WHEN size(s) > {size} THEN {shrink} ELSE s END), 0))"


def normalized(h: str, by: int) -> str:
    """SQL: counts divided by a number, rounded down; what comes to nothing is left out."""
    return f"filter(transform({h}, e -> named_struct('x', e.x, 'n', e.n div {by})), e -> e.n > 0)"


def bounded(df: DataFrame, by: list[str], x: Column, size: int, parts: int = 16, whole: bool = False) -> DataFrame:
    """by, h: a bounded histogram of each group's values.

    Equal values are counted first. Each of `parts` parts of a group's values (by the whole number below a value)
    is inserted in rising order with at most size + 1 entries at a time, and the parts' histograms merge in order; so a
    group's work is spread, and what meets for a group is parts x size entries.
    """
    kind = "bigint" if whole else "double"
    counts = df.select(*by, x.cast(kind).alias("x")).filter("x IS NOT NULL").groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.floor("x"), F.lit(parts)).alias("part")
    each = counts.groupBy(*by, part).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("e"))
    each = each.select(*by, "part", F.expr(inserted("e", size, whole)).alias("h"))
    listed = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "h"))).alias("p"))
    return listed.select(*by, F.expr(merged("transform(p, q -> q.h)", size, whole)).alias("h"))


def agglomerate(points, radius: float):
    """Centroids and weights after the closest pair within the radius was merged into its weighted centroid as often as there is one.

    Each point keeps only its nearest later neighbour, so memory grows with the points and not with their pairs; a pass by
    blocks finds the points that have one. The least pair in row order goes first among equals.
    """
    import numpy as np

    m = np.array(points, float)
    n = len(m)
    weights, alive = np.ones(n), np.ones(n, bool)
    near, at = np.full(n, np.inf), np.full(n, -1)

    def search(k: int) -> None:
        dist = np.linalg.norm(m[k + 1 :] - m[k], axis=1)
        dist[~alive[k + 1 :] | (dist > radius)] = np.inf
        j = int(dist.argmin()) if len(dist) else -1
        near[k], at[k] = (dist[j], k + 1 + j) if j >= 0 and dist[j] < np.inf else (np.inf, -1)

    squares = (m * m).sum(axis=1)
    step = max(1, (1 << 21) // max(n, 1))
    for a in range(0, n, step):
        # products are not exact: who may have a neighbour is searched again by differences
        far = squares[a : a + step, None] + squares[None] - 2 * m[a : a + step] @ m.T
        later = np.arange(n)[None] > np.arange(a, min(a + step, n))[:, None]
        slack = 1e-9 * (squares[a : a + step, None] + squares[None] + 1)
        for k in np.flatnonzero(((far <= radius * radius + slack) & later).any(axis=1)):
            search(a + int(k))
    while n and near.min() < np.inf:
        i = int(near.argmin())
        j = int(at[i])
        w = weights[i] + weights[j]
        m[i], weights[i] = (m[i] * weights[i] + m[j] * weights[j]) / w, w
        alive[j], near[j], at[j] = False, np.inf, -1
        for k in np.flatnonzero(alive & ((at == i) | (at == j))):
            search(int(k))
        search(i)
        dist = np.linalg.norm(m[:i] - m[i], axis=1)
        closer = alive[:i] & (dist <= radius) & ((dist < near[:i]) | ((dist == near[:i]) & (i < at[:i])))
        near[:i][closer], at[:i][closer] = dist[closer], i
    return m[alive], weights[alive].tolist()
