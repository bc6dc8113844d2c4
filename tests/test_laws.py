"""Laws of mergeable states, logs, differences and the wire format."""

from pyspark.sql import functions as F

from keystrata.operators import crdt, recon
from keystrata.operators import transactions as tx
from keystrata.operators.graph import closure
from keystrata.sources.dump import recoverable
from keystrata.sources.wire import decode, encode


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counters_merge(spark):
    a = spark.createDataFrame([("x", 0, 3), ("x", 1, 1), ("y", 0, 2)], "name string, replica int, n long")
    b = spark.createDataFrame([("x", 0, 2), ("x", 2, 5)], "name string, replica int, n long")
    ab = crdt.merge_counter(a, b)
    assert rows(ab) == rows(crdt.merge_counter(b, a)) == rows(crdt.merge_counter(ab, b, a))
    assert dict(rows(crdt.counter_value(ab))) == {"x": 9, "y": 2}
    v, w = crdt.counter_vector(a, 3), crdt.counter_vector(ab, 3).withColumnRenamed("v", "w")
    assert all(r.ok for r in v.join(w, "name").select(crdt.below(F.col("v"), F.col("w")).alias("ok")).collect())


def test_sets_merge(spark):
    s = "elem string, replica int, ts long"
    a = spark.createDataFrame([("k", 0, 1), ("gone", 0, 2), ("new", 0, 9)], s)
    b = spark.createDataFrame([("k", 0, 1), ("other", 1, 4)], s)
    va, vb = spark.createDataFrame([(0, 9)], "replica int, seen long"), spark.createDataFrame([(0, 3), (1, 4)], "replica int, seen long")
    want = [("k", 0, 1), ("new", 0, 9), ("other", 1, 4)]  # b had seen "gone" and removed it
    assert rows(crdt.merge_orset(a, b, va, vb)) == want == rows(crdt.merge_orset(b, a, vb, va))


def test_replay(spark):
    ops = [(1, 1, "write", 5.0, None), (1, 2, "add_on_nr", 2.0, None), (1, 3, "test_and_set", 9.0, 7.0), (1, 4, "test_and_set", 1.0, 7.0), (2, 1, "add_on_nr", 3.0, None), (3, 1, "read", None, None)]
    df = spark.createDataFrame(ops, "k int, seq int, op string, arg double, expected double").repartition(3)
    assert {r.k: (r.value, r.failed, r.n) for r in tx.replay(df, "k", "seq").collect()} == {1: (9.0, 1, 4), 2: (3.0, 0, 1), 3: (None, 0, 1)}


def test_transfers_keep_the_total(spark):
    accounts = spark.createDataFrame([("a", 1000), ("b", 0), ("c", 0)], "key string, balance long")
    moves = spark.createDataFrame([("a", "b", 300), ("b", "c", 100), ("c", "a", 1)], "src string, dst string, amount long")
    assert rows(tx.transfer(accounts, moves)) == [("a", 701), ("b", 200), ("c", 99)]


def test_resolve_ends_all_differences(spark):
    s = "key int, version long, value string, locked boolean"
    a = spark.createDataFrame([(1, 1, "old", False), (2, 5, "a", False), (4, 1, "held", True)], s)
    b = spark.createDataFrame([(1, 2, "new", False), (3, 1, "b", False), (4, 2, "n", False)], s)
    done = recon.resolve(a, b, "key", "version", "value", F.col("locked"))
    assert rows(done) == [(1, 2, "new", "update"), (2, 5, "a", "keep"), (3, 1, "b", "regen"), (4, 1, "held", "keep")]
    assert {r.state for r in recon.compare(done, b, "key", "version").collect()} == {"b_missing", "a_outdated"}


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(closure(edges, start)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(closure(edges, start, 1)) == [(1, 0), (2, 1)]


def test_wire(spark, tmp_path):
    df = spark.createDataFrame([("naïve \"x\"",)], "v string")
    for binary, kind in ((False, "as_is"), (True, "as_bin")):
        r = df.select(decode(encode(F.col("v"), binary)).alias("d")).first().d
        assert (r.type, r.value) == (kind, "naïve \"x\"")
    for n in ("kv_1", "kv_2", "other"):
        (tmp_path / n).mkdir()
    assert recoverable(spark, str(tmp_path), "kv_") == ["kv_1", "kv_2"] and recoverable(spark, str(tmp_path / "none"), "kv_") == []
