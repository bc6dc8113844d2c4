"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Boosted trees are grown on the statistics of labelled texts. Every path from a root to a node is a
conjunctive rule; a logistic regression with an L1 penalty weighs the rules, and those that keep a
weight become one column expression: the sum of the weights of the rules that hold. Scoring
is a scan with JVM expressions, without a shuffle.

Training reads a bounded sample: of the labelled rows in the training folds (crc32 of the id's text
modulo 3 isn't 1) the `sample` rows with the least hash of their id. Its statistics, a short vector
a row, are collected; everything else covers all rows.

Defined results: null and empty texts have all statistics 0 and are scored so; very long texts are scored
whole, in one row; a null id counts as not held out; repeated rows are scored each; without any usable label
the score is 0.5; labels that are null are left out, of several labels of an id the least counts, and of
several documents of an id the one with the least statistics is learnt from; an empty table gives none. Further
columns pass through, whatever their names, but for score and predicted, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm import boosting
from keystrata.llm.common import fresh, text_of

SAMPLE, FOLD = 12_000, 1


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == FOLD, F.lit(False))


def statistics(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """df with the statistics of its text column, and the names that they have there."""
    t, n = F.col(text), F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    w, ln = fresh(df.columns, "words", "lines")
    words, lines = F.col(w), F.col(ln)
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)).cast("double"), F.greatest(F.size(lines), F.lit(1)).cast("double")
    made = {
        "s_log_chars": F.log1p(F.length(text).cast("double")),
        "s_upper": share(r"\p{Lu}"),
        "s_digit": share("[0-9]"),
        "s_odd": share(r"[#$%&*<>{}=~^_@\\/+]"),
        "s_stop": share("[!?]"),
        "s_bar": share(r"\|"),
        "s_end": share(r"[.!?](?=\s|$)"),
        "s_word": F.length(text) / n_words,
        "s_new_words": F.size(F.array_distinct(words)) / n_words,
        "s_new_lines": F.size(F.array_distinct(lines)) / n_lines,
        "s_line": F.log1p(F.length(text) / n_lines),
    }
    empty = F.length(text) == 0
    names = fresh([*df.columns, w, ln], *made)
    out = df.withColumns({w: F.split(t, r"\s+"), ln: F.split(t, "\n")})
    return out.withColumns({k: F.when(empty, 0.0).otherwise(v.cast("double")) for k, v in zip(names, made.values(), strict=True)}).drop(w, ln), names


Rule = list[tuple[int, bool, float]]  # (feature, at most the threshold?, threshold), all of which must hold


def paths(tree: boosting.Tree, before: tuple = ()) -> list[Rule]:
    """Every path from the root to another node."""
    if not isinstance(tree, tuple):
        return []
    j, t, left, right = tree
    out = []
    for side, child in ((True, left), (False, right)):
        rule = [*before, (j, side, t)]
        out += [rule, *paths(child, tuple(rule))]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, t in rule:
        out &= (x[:, j] <= t) == below
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = r.shape
    mean = r.mean(axis=0)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    z = (r - mean) / spread
    bound = (np.linalg.norm(z, 2) ** 2 / n + 1) / 4
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - (z.T @ e / n) / bound
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / bound, 0)
        b2, t2 = c - e.mean() / bound, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b - (w / spread) @ mean), w / spread


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 1) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules; the penalty is the one with the least loss on a quarter of the rows, then all are used."""
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(p / (1 - p))), []
    least = max(1, min(20, len(y) // 20))
    _, grown = boosting.fit(x, y, trees, depth, rate=0.4, least=least, share=0.6, seed=seed)
    rules, masks, seen = [], [], set()
    for rule in (p for t in grown for p in paths(t)):
        m = holds(rule, x)
        key = min(m.tobytes(), (~m).tobytes())
        if key not in seen and 0 < m.sum() < len(m):
            seen.add(key)
            rules.append(rule)
            masks.append(m)
    r = np.array(masks, float).T
    test = np.random.default_rng(seed).random(len(y)) < 0.25
    best = (np.inf, 1e-3)
    for penalty in (0.03, 0.01, 0.003, 0.001):
        b, w = lasso(r[~test], y[~test], penalty)
        m = r[test] @ w + b
        loss = float(np.mean(np.logaddexp(0, m) - y[test] * m)) if test.any() else 0.0
        best = min(best, (loss + 1e-4 * (np.abs(w) > 1e-9).sum(), penalty))
    b, w = lasso(r, y, best[1])
    return b, [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-9]


def compiled(model: tuple[float, list[tuple[Rule, float]]], names: list[str]) -> Column:
    """The score as a column over the statistics."""
    margin = F.lit(model[0])
    for rule, weight in model[1]:
        test = F.lit(True)
        for j, below, t in rule:
            test = test & (F.col(names[j]) <= t if below else F.col(names[j]) > t)
        margin = margin + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return boosting.sigmoid(margin)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """A model from at most `sample` labelled rows of the training folds."""
    few = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    few = few.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # bounded by `sample` rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(few), "_id")
    rows, names = statistics(rows, "_text")
    one = rows.groupBy("_id").agg(F.min(F.struct(*names)).alias("x"), F.min("_y").alias("y"))
    got = sorted((*r.x, r.y) for r in one.select("x", "y").collect())
    x, y = np.array([g[:-1] for g in got], float).reshape(len(got), len(names)), np.array([g[-1] for g in got], float)
    return fit_rules(x, (y > 0.5).astype(float))


def scored(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text_col: str, name: str) -> DataFrame:
    """docs with the score (0 to 1) under a name that none of its columns has."""
    (text,) = fresh([*docs.columns, name], "t")
    rows, names = statistics(docs.select(*(F.col(f"`{c}`") for c in docs.columns), text_of(text_col).alias(text)), text)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), compiled(model, names).alias(name))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted; an input column of these names is replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return scored(docs.select(*(F.col(f"`{c}`") for c in kept)), model, text_col, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text_col: str = "text") -> DataFrame:
    """Those of docs that are scored 0.5 or more.

    The filter must not reach below the projection: it would compute each rule's statistics anew. A
    column that isn't deterministic, and that the filter reads, keeps it above.
    """
    name, row = fresh(docs.columns, "score", "row")
    held = scored(docs, model, text_col, name).withColumn(row, F.monotonically_increasing_id())
    return held.filter((F.col(name) >= 0.5) & (F.col(row) >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
