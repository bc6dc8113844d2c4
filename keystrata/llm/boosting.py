"""Gradient-boosted trees on a bounded matrix on the driver or on a table of any size, and their form as Spark columns.

A tree is a leaf's value or (feature, threshold, left, right); a row goes left if its feature is at
most the threshold. Training is deterministic: thresholds are quantiles, ties take the first split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.sources.scratch import discard, materialize

Tree = float | tuple


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature, half-way between neighbouring quantiles."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(binned: np.ndarray, at: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, l2: float) -> Tree:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(-g / (h + l2))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    for j, t in enumerate(at):
        if not len(t):
            continue
        b = binned[rows, j]
        n = np.cumsum(np.bincount(b, minlength=len(t) + 1))[:-1]
        gl = np.cumsum(np.bincount(b, grad[rows], len(t) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, hess[rows], len(t) + 1))[:-1]
        score = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
        score[(n < least) | (len(rows) - n < least)] = -1
        k = int(score.argmax())
        if score[k] > gain:
            best, gain = (j, k), float(score[k])
    if best is None:
        return leaf
    j, k = best
    left = binned[rows, j] <= k
    go = lambda r: grow(binned, at, grad, hess, r, depth - 1, least, l2)
    return (j, float(at[j][k]), go(rows[left]), go(rows[~left]))


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, left, right = tree
    return np.where(x[:, j] <= t, predict(left, x), predict(right, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.3, least: int = 20, bins: int = 64, l2: float = 1.0, share: float = 1.0, seed: int = 0) -> tuple[float, list[Tree]]:
    """Base log-odds and trees (already scaled) of the logistic loss; share: of the rows that a tree sees."""
    r = np.random.default_rng(seed)
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    at = cuts(x, bins) if len(x) else []
    binned = np.stack([np.searchsorted(t, x[:, j]) for j, t in enumerate(at)], axis=1) if len(x) else x
    margin, trees = np.full(len(x), base), []
    for _ in range(rounds if len(x) else 0):
        q = 1 / (1 + np.exp(-margin))
        rows = np.arange(len(x)) if share >= 1 else np.flatnonzero(r.random(len(x)) < share)
        tree = scaled(grow(binned, at, q - y, q * (1 - q), rows, depth, least, l2), rate)
        trees.append(tree)
        margin += predict(tree, x)
    return base, trees


#: Gradients are summed as whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 24
#: Rows that are worth a task of their own: a pass over fewer is one task without a shuffle.
TASK = 1 << 16


def gradients(rows: DataFrame) -> DataFrame:
    """rows (b, y, w and the log-odds m so far) with first and second derivatives g and h of their loss, in UNITs."""
    whole = lambda x: F.col("w") * F.rint(x * UNIT).cast("long")
    q = F.col("q")
    return rows.withColumn("q", sigmoid(F.col("m"))).select("b", "y", "w", "m", whole(q - F.col("y")).alias("g"), whole(q * (1 - q)).alias("h"))


def sums(rows: DataFrame, nodes: Tree, first: int, width: int, sizes: list[int]) -> np.ndarray:
    """w, g and h of rows summed by node (a leaf of nodes is a node's number; `width` of them from `first` on), feature and bin: no more sums than there are bins of nodes reach the driver."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    each = rows.select((F.expr(sql(nodes, "b")).cast("int") - first).alias("node"), "b", "w", "g", "h").filter("node >= 0")
    bins = each.select("node", "w", "g", "h", F.posexplode("b").alias("feature", "bin")).groupBy("node", "feature", "bin")
    out = np.zeros((3, width, at[-1]), np.int64)
    for r in bins.agg(*(F.sum(x).alias(x) for x in "wgh")).collect():
        out[:, r.node, at[r.feature] + r.bin] = r.w, r.g, r.h
    return out


def margins(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        out += predict(t, x)
    return out


def fit_groups(groups: DataFrame, sizes: list[int], rounds: int, depth: int, rate: float = 0.3, least: int = 20, l2: float = 1.0) -> tuple[float, list[Tree]]:
    """As fit(), from every row of a table of any size: groups has bins b (array<int>), label y and weight w, feature j has sizes[j] bins.

    Each tree begins with a table of the log-odds and gradients after those before; each of its levels is one pass
    that sums gradients by node, feature and bin. All are native expressions, and a pass evaluates one tree however
    many there are. Thresholds of the trees are bins.
    """
    at = np.concatenate([[0], np.cumsum(sizes)])
    n, ones, count = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-count // TASK))
    p = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
    base, trees = float(np.log(p / (1 - p))), []
    rows, old = groups.select("b", "y", "w", F.lit(base).alias("m")).coalesce(tasks), None
    for _ in range(rounds if n else 0):
        here = materialize(gradients(rows), "gradients").coalesce(tasks)
        if old:
            discard(old)
        splits: dict[int, tuple[int, int]] = {}  # node i has children 2i + 1 and 2i + 2
        value: dict[int, float] = {}
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            if level and not any((i - 1) // 2 in splits for i in range(first, first + width)):
                break

            nodes = lambda i: (*splits[i], nodes(2 * i + 1), nodes(2 * i + 2)) if i in splits else i  # noqa: B023, E731
            got = sums(here, nodes(0), first, width, sizes)
            for i in range(width):
                counts, g, h = got[0, i], got[1, i] / UNIT, got[2, i] / UNIT
                all_, gs, hs = counts[: sizes[0]].sum(), g[: sizes[0]].sum(), h[: sizes[0]].sum()
                if not all_:
                    continue
                value[first + i] = float(-gs / (hs + l2))
                best, gain = None, 1e-6
                for j, s in enumerate(sizes):
                    c, gl, hl = (np.cumsum(z[at[j] : at[j + 1]])[:-1] for z in (counts, g, h))
                    score = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    score[(c < least) | (all_ - c < least)] = -1
                    b = int(score.argmax())
                    if score[b] > gain:
                        best, gain = (j, b), float(score[b])
                        ends = float(-gl[b] / (hl[b] + l2)), float(-(gs - gl[b]) / (hs - hl[b] + l2))
                if best and all_ >= 2 * least:
                    splits[first + i] = best
                    value[2 * (first + i) + 1], value[2 * (first + i) + 2] = ends
        nested = lambda i: (*splits[i], nested(2 * i + 1), nested(2 * i + 2)) if i in splits else value[i]  # noqa: B023, E731
        trees.append(scaled(nested(0), rate))
        rows, old = here.select("b", "y", "w", F.expr(f"m + {sql(trees[-1], 'b')}").alias("m")), here
    if old:
        discard(old)
    return base, trees


def with_cuts(tree: Tree, cuts_: list[np.ndarray]) -> Tree:
    """A tree over bins as one over features: bin k of feature j ends at cuts_[j][k]."""
    return (tree[0], float(cuts_[tree[0]][tree[1]]), with_cuts(tree[2], cuts_), with_cuts(tree[3], cuts_)) if isinstance(tree, tuple) else tree


def scaled(tree: Tree, by: float) -> Tree:
    return (*tree[:2], scaled(tree[2], by), scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


def sql(tree: Tree, features: str) -> str:
    """The tree over an array of features, as SQL."""
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    j, t, left, right = tree
    return f"CASE WHEN {features}[{j}] <= {float(t)!r}D THEN {sql(left, features)} ELSE {sql(right, features)} END"


def log_odds(base: float, trees: list[Tree], features: str) -> str:
    """The log-odds of an array of features, as SQL."""
    return " + ".join([f"{float(base)!r}D", *(sql(t, features) for t in trees)])


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
