"""Op 6 and the pipeline's stage pii train and search by DataFrame operations: no plan that runs holds a Python node."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from keystrata.llm import boosting, pii, queries  # noqa: E402

ROWS = [(i, f"some words +1 ({200 + i}) 555-{1000 + i} and more, rated 3.5 of 10 in 1999") for i in range(150)]
ROWS += [(500 + i, f"order 20{i:02d} 01 0{i % 9} came at 10.30 - 11.45, no. {i}") for i in range(90)]


def plans(spark, do):
    """The physical plans of all that do() runs."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()

    def seen():
        bus.waitUntilEmpty()
        every = store.executionsList()
        return {every.apply(i).executionId(): every.apply(i).physicalPlanDescription() for i in range(every.size())}

    before = seen()
    do()
    return [p for k, p in seen().items() if k not in before]


def python(ran):
    return {x for p in ran for x in re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", p)}


def test_a_python_node_is_seen(spark):
    assert python(plans(spark, lambda: spark.range(3).mapInArrow(lambda x: x, "id long").collect()))


def test_op6_runs_no_python(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    models = []
    ran = plans(spark, lambda: models.append(pii.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))))
    assert models[0][1] and len(ran) > 24 and not python(ran)
    ran = plans(spark, lambda: queries.QUERIES["op6_pii"](spark, str(tmp_path)).collect())
    assert len(ran) > 24 and not python(ran)


def test_tasks_grow_the_trees_of_one_task(spark, monkeypatch):
    rows = [([i * 7 % 6, i * 5 % 4, i % 2], int((i * 7 % 6 > 2) ^ (i % 11 == 0)), i % 5 + 1) for i in range(700)]
    groups = spark.createDataFrame(rows, "b array<int>, y int, w long").repartition(7)
    whole = boosting.fit_groups(groups, [6, 4, 2], 3, 3)
    assert all(isinstance(t, tuple) for t in whole[1])
    monkeypatch.setattr(boosting, "TASK", 100)
    assert boosting.fit_groups(groups, [6, 4, 2], 3, 3) == whole
    assert boosting.fit_groups(groups.filter("false"), [6, 4, 2], 3, 3)[1] == []


def test_pipeline_pii_runs_no_python(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = []
    ran = plans(spark, lambda: got.extend(dict(corpus_pipeline.STAGES)["pii"](spark, docs, str(tmp_path)).collect()))
    assert len(ran) > 24 and not python(ran)
    assert {r.doc_id: r.text for r in got}[3] == "some words [PHONE] and more, rated 3.5 of 10 in 1999"
