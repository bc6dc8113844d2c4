"""op 1: held-out accuracy, rules as columns, hard cases."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import boosting, quality  # noqa: E402

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    assert 0 < len(model[1]) < 80
    got = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(quality.held_out()).collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert len(got) > 80 and auc > 0.97 and ((s >= 0.5) == y).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_columns_equal_the_rules(spark):
    r = np.random.default_rng(2)
    x = r.random((500, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    want = 1 / (1 + np.exp(-(model[0] + sum(w * quality.holds(rule, x) for rule, w in model[1]))))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    got = [v.s for v in df.select("i", quality.compiled(model, ["a", "b", "c"]).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97
    base, trees = boosting.fit(x, y, 5, 2)
    total = " + ".join([f"{base!r}D", *(boosting.sql(t, "f") for t in trees)])
    got = [v.s for v in df.selectExpr("i", "array(a, b, c) AS f").selectExpr("i", f"{total} AS s").orderBy("i").collect()]
    assert np.allclose(got, base + sum(boosting.predict(t, x) for t in trees))


def test_hard_cases(spark):
    docs = table(spark, hard())
    model = quality.train(docs, spark.createDataFrame([(3, 1), (3, 0), (6, None), (None, 1), (9, 0)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_statistics_equal_a_plain_count(spark):
    import math
    import re

    texts = ["Ab c 12!\n| x. Y?\nAb c", "", "  lead\t\n tail ", "ÉA ß $%{}.", "one"]
    rows, names = quality.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text")
    for r in rows.collect():
        t = r.text
        n = max(len(t), 1)
        words, lines = re.split(r"\s+", t), t.split("\n")
        count = lambda p: len(re.findall(p, t)) / n
        want = [
            math.log1p(len(t)), sum(c.isupper() for c in t) / n, count("[0-9]"), count(r"[#$%&*<>{}=~^_@\\/+]"), count("[!?]"), count(r"\|"), count(r"[.!?](?=\s|$)"),
            len(t) / len(words), len(set(words)) / len(words), len(set(lines)) / len(lines), math.log1p(len(t) / len(lines)),
        ]
        assert np.allclose([r[k] for k in names], want if t else [0.0] * len(names)), t


def test_clashing_names(spark):
    rows = [(i, f"Some words {i}. " * (1 + i % 7), 1.5, "a", "b", "c", -1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s_digit double, _text string, words string, t string, score int")
    model = quality.train(docs, spark.createDataFrame([(i, int(i % 7 > 3)) for i in range(60)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "s_digit", "_text", "words", "t", "score", "predicted"] and {(r.s_digit, r._text, r.words, r.t) for r in got} == {(1.5, "a", "b", "c")}
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted} and {r.score for r in kept.collect()} == {-1}


def test_accepting_computes_statistics_once(spark):
    docs = table(spark, hard())
    model = quality.train(docs, spark.createDataFrame([(i * 3, i % 2) for i in range(40)], "doc_id long, quality int"))
    plan = quality.accept(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    scoring = quality.score(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("regexp_count") == scoring.count("regexp_extract_all") + scoring.count("regexp_count")


def test_repeated_ids(spark):
    """Of several documents of an id one is learnt from, whatever the order of rows."""
    rows = [(i % 20, "word " * (i + 1)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    a = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert a == quality.train(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), labels)
