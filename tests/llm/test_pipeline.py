"""The pipeline's stages, each against what brute force keeps of its input."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402
from test_bagminhash import classes  # noqa: E402
from test_pii import brute  # noqa: E402
from test_tokens import best_fit_decreasing  # noqa: E402

import corpus_pipeline as p  # noqa: E402
from keystrata.llm.common import documents, materialize  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, names = documents(spark, DATA), [n for n, _ in p.STAGES]
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        after = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns and after
        now = {r.doc_id: r for r in after}
        assert len(now) == len(after) and now.keys() <= before.keys()
        if name == "quality":
            good = [d for d in before if quality.get(d) == 1]
            bad = [d for d in before if quality.get(d) == 0]
            assert sum(d in now for d in good) >= 0.98 * len(good) and sum(d in now for d in bad) <= 0.1 * len(bad)
        if name == "exact":
            assert {max(d for d in before if before[d].text == t) for t in {r.text for r in before.values()}} == now.keys()
        if name == "near":
            ids = sorted(before)
            groups = defaultdict(list)
            for d, c in zip(ids, classes([before[d].text for d in ids]), strict=True):
                groups[c].append(d)
            assert {min(g) for g in groups.values()} == now.keys()
        if name == "pii":
            assert now.keys() == before.keys()
            for d, r in now.items():
                assert not brute(r.text) and r.n_chars == len(r.text)
                if not brute(before[d].text) and "=" not in before[d].text and '"' not in before[d].text:
                    assert r.text == before[d].text
        else:
            assert all(now[d] == before[d] for d in now)
        before = now
    assert names == ["quality", "exact", "near", "pii", "packing"]
    assert {r.doc_id for r in after} == before.keys()
    assert len({r.sequence_id for r in after}) == best_fit_decreasing([r.length for r in after], 2048)


def test_run(spark):
    assert p.run(spark, DATA).count() > 100


def test_hard_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, columns named as results: every stage keeps the columns of its input."""
    data = hard(60, words=60)
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x[0], i % 4 and 1) for i, x in enumerate(data) if x[0] is not None], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    out = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and all(len(r.ids) == r.length for r in out)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
