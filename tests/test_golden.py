"""Fixed examples and laws of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import json_path as jp
from keystrata.functions import keys as ky
from keystrata.operators import lists as ls
from keystrata.operators import mapreduce as mr
from keystrata.operators import sketch as sk
from keystrata.operators.intervals import Interval, split
from keystrata.operators.objects import ObjectQuery

LETTERS = list("abcdefg")
#: Start, length and what is read.
SUBLISTS = [
    (1, 0, ""), (1, 3, "abc"), (1, 10, "abcdefg"), (7, 10, "g"), (8, 10, ""), (1, -2, "a"), (3, -5, "cba"), (8, -1, "g"), (-1, 3, "g"), (-3, 10, "efg"),
    (-8, 10, "abcdefg"), (-10, 10, "abcdefg"), (-1, -3, "gfe"), (-3, -10, "edcba"), (-7, -10, "a"), (-8, -10, ""),
]


def test_sublists(spark):
    df = spark.createDataFrame([(LETTERS, a, n, w) for a, n, w in SUBLISTS], "arr array<string>, a int, n int, want string")
    got = df.select("a", "n", "want", F.array_join(ls.sublist(F.col("arr"), F.col("a"), F.col("n")), "").alias("got")).collect()
    assert all(r.got == r.want for r in got), [r for r in got if r.got != r.want]


def test_list_updates(spark):
    r = spark.createDataFrame([([1, 2, 1, 3], [9], [1, 3, 7])], "old array<int>, add array<int>, del array<int>")
    row = r.select(ls.add_then_remove(F.col("old"), F.col("add"), F.col("del")).alias("a"), ls.without_all(F.col("old"), F.col("del")).alias("b"), ls.blocks(F.col("old"), 3).alias("c"), ls.remove_at(F.col("old"), F.array(F.lit(1), F.lit(4))).alias("d")).first()
    assert row.a == [9, 2, 1] and row.b == [2] and row.c == [[1, 2], [1], [3]] and row.d == [2, 1]


#: Size, what is inserted (value, count) in order, and the histogram that it gives.
HISTOGRAMS = [
    (10, [(3.5, 1), (3.0, 1), (2.0, 1), (1.0, 1)], [(1.0, 1), (2.0, 1), (3.0, 1), (3.5, 1)]),
    (10, [(3.5, 2), (3.0, 1), (2.0, 5), (1.0, 7)], [(1.0, 7), (2.0, 5), (3.0, 1), (3.5, 2)]),
    (2, [(1.25, 1), (5.0, 1), (5.0, 1)], [(1.25, 1), (5.0, 2)]),
    (2, [(1.25, 1), (5.0, 1), (5.0, 1), (1.25, 1), (5.0, 1), (5.0, 1)], [(1.25, 2), (5.0, 4)]),
    (4, [(2.0, 1), (3.5, 2), (3.0, 1), (2.0, 6), (1.0, 3)], [(1.0, 3), (2.0, 7), (3.0, 1), (3.5, 2)]),
    (5, [(x, 1) for x in (1, 2, 3, 4, 5, 3, 4, 10)], [(1, 2), (3, 2), (4, 2), (5, 1), (10, 1)]),
    (3, [(3.5, 1), (3.0, 1), (2.0, 1), (1.0, 1)], [(1.0, 1), (2.0, 1), (3.25, 2)]),
    (0, [(1.0, 1)], []),
]


def folded(spark, size, values):
    whole = all(isinstance(x, int) for x, _ in values)
    df = spark.createDataFrame([(values,)], f"e {sk.histogram_type(whole)}")
    return [tuple(r) for r in df.select(F.expr(sk.inserted("e", size, whole)).alias("h")).first().h]


@pytest.mark.parametrize(("size", "values", "want"), HISTOGRAMS)
def test_histogram(spark, size, values, want):
    got = folded(spark, size, values)
    if size == 4 or size == 10 and len(values) > 4:  # equal values may stand side by side while there is room
        assert sorted(got) == got
    back = {}
    for x, n in got:
        back[x] = back.get(x, 0) + n
    assert sorted(back.items()) == want and sum(n for _, n in got) == (sum(n for _, n in values) if size else 0)


def model(values, size):
    """A bounded histogram by the rule: the closest neighbours, first pair first, become one at their mean."""
    out = []
    for v in values:
        i = next((i for i, e in enumerate(out) if v[0] <= e[0]), len(out))
        out = [*out[:i], v, *out[i:]]
        if len(out) > size:
            gaps = [b[0] - a[0] for a, b in zip(out, out[1:])]
            i = gaps.index(min(gaps))
            (a, m), (b, n) = out[i], out[i + 1]
            out = [*out[:i], ((a * m + b * n) / (m + n), m + n), *out[i + 2 :]]
    return out


def test_histograms_of_random_values(spark):
    r = random.Random(4)
    for size in (1, 2, 5, 9):
        values = [(round(r.uniform(-9, 9), 2), r.randrange(1, 5)) for _ in range(40)]
        assert folded(spark, size, values) == model(values, size)
    parts = [[(float(r.randrange(30)), 1) for _ in range(20)] for _ in range(3)]
    made = [model(p, 6) for p in parts]
    df = spark.createDataFrame([(made,)], f"h array<{sk.histogram_type(False)}>")
    both = [tuple(x) for x in df.select(F.expr(sk.merged("h", 6)).alias("h")).first().h]
    assert sum(n for _, n in both) == 60 and len(both) == 6 and sorted(both) == both
    assert [tuple(x) for x in df.select(F.expr(sk.normalized("h[0]", 3)).alias("h")).first().h] == [(x, n // 3) for x, n in made[0] if n >= 3]


def test_bounded_histogram_by_groups(spark):
    rows = [(g, float((i * 37 + g) % 101)) for g in range(3) for i in range(200)] + [(3, None)]
    got = {r.g: r.h for r in sk.bounded(spark.createDataFrame(rows, "g int, v double"), ["g"], F.col("v"), 7).collect()}
    assert got.keys() == {0, 1, 2} and all(sum(e.n for e in h) == 200 and len(h) == 7 for h in got.values())


def test_slots(spark):
    from keystrata.operators import series as sr

    rows = spark.createDataFrame([(20, 5.0), (25, 6.0), (30, 1.0), (42, 2.0)], "t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    out = rows.groupBy(sr.slot_of("ts", "10 seconds").alias("slot")).agg(sr.gauge("v", "t").alias("g"), sr.counter("v").alias("c"), *sr.timing("v")).orderBy("slot").collect()
    assert [(r.g, r.c) for r in out] == [(6.0, 11.0), (1.0, 1.0), (2.0, 2.0)]
    assert (out[0]["sum"], out[0]["sum2"], out[0]["n"], out[0]["least"], out[0]["most"]) == (11.0, 61.0, 2, 5.0, 6.0)
    kept = spark.createDataFrame([(1, 20), (1, 30), (1, 40), (1, 60)], "g int, t long").withColumn("slot", F.timestamp_seconds("t"))
    assert [r.t for r in sr.retained(kept, ["g"], "slot", 10, 3).orderBy("t").collect()] == [40, 60]


def test_word_count(spark):
    texts = ["A pump feeds the tank and the tank feeds the mill", "The mill turns while a river is high", "No river no mill", "Turns of a wheel count once for each pump"]
    df = spark.createDataFrame([(None, str(i), t) for i, t in enumerate(texts)] + [("other", "x", "not counted")], "tag string, k string, v string")
    split_ = mr.Phase("map", F.transform(mr.words(F.col("v")), lambda w: F.struct(w.alias("k"), F.lit(1).alias("v"))))
    got = {r.k: r.v for r in mr.run(df, [split_, mr.Phase("reduce", F.sum("v"))]).collect()}
    want = {}
    for t in texts:
        for w in t.lower().split():
            want[w] = want.get(w, 0) + 1
    assert got == want
    tagged = mr.run(df, [split_, mr.Phase("reduce", F.sum("v"))], tag="other").collect()
    assert {r.k for r in tagged} == {"not", "counted"}
    assert mr.run(df, [], tag=3).first().k == "bad_phase"


def test_object_queries(spark):
    rows = [(1, "Sony Discman", 1.99), (2, "Xperia Z1", 200.3), (3, "Z2", 300.1), (4, "Z3", 400.2), (5, "Z1 Compact", 250.7)]
    q = ObjectQuery(spark.createDataFrame(rows, "id long, name string, price double"))
    assert q.where("name = 'Z2'").result().count() == 1 and q.where("price < 300.1").result().count() == 3
    assert [r.id for r in q.order("price").range(1, 3).result("id").collect()] == [2, 5]
    assert q.where("missing_is_null is null" if False else "cast(null as boolean)").result().count() == 0


def test_json_patch():
    doc = {"a": [1, 2], "b": {"c": 3}}
    assert jp.apply_patch(doc, [{"op": "add", "path": ["a", 1], "value": 9}, {"op": "add", "path": ["a", "-"], "value": 8}]) == {"a": [1, 9, 2, 8], "b": {"c": 3}}
    assert jp.apply_patch(doc, [{"op": "move", "from": ["b", "c"], "path": ["d"]}, {"op": "copy", "from": ["a"], "path": ["e"]}]) == {"a": [1, 2], "b": {}, "d": 3, "e": [1, 2]}
    assert jp.apply_patch(doc, [{"op": "replace", "path": ["a", 0], "value": 0}, {"op": "test", "path": ["a", 0], "value": 0}, {"op": "remove", "path": ["a", "-"]}]) == {"a": [0], "b": {"c": 3}}
    for bad in ({"op": "replace", "path": ["x"], "value": 1}, {"op": "remove", "path": ["a", 7]}, {"op": "test", "path": ["b"], "value": 1}, {"op": "swap", "path": []}):
        with pytest.raises(jp.PatchError):
            jp.apply_patch(doc, [{"op": "add", "path": ["n"], "value": 1}, bad])
    assert doc == {"a": [1, 2], "b": {"c": 3}}


def test_intervals(spark):
    df = spark.range(20)
    keys = lambda i: [r.id for r in df.filter(i.test(F.col("id"))).orderBy("id").collect()]
    assert keys(Interval(5, 8)) == [5, 6, 7, 8] and keys(Interval(5, 8, False, False)) == [6, 7]
    assert keys(Interval(17, 2)) == [0, 1, 2, 17, 18, 19] and keys(Interval(4, 4)) == [4]
    assert keys(Interval(4, 4, True, False)) == [] and len(keys(Interval(None, None))) == 20
    parts = split(0, 20, 3)
    assert sorted(k for p in parts for k in keys(p)) == list(range(20))


def test_keys(spark):
    assert [n for n in range(60) if ky.prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert ky.prime(2**61 - 1) and not ky.prime((2**31 - 1) * (2**31 + 11))
    for n, base in ((0, 10), (255, 2), (10**30, 10**6)):
        assert ky.from_digits(ky.to_digits(n, base), base) == n
    r = spark.createDataFrame([("k",)], "k string").withColumn("h", ky.hashed("k")).select("h", ky.replicas(F.col("h"), 16).alias("r")).first()
    assert len(set(r.r)) == 16 and r.h in r.r and {x[1:] for x in r.r} == {r.h[1:]}
    assert ky.between("0" * 32, "f" * 32, 1, 2) == "7" + "f" * 31


def test_invertible_sketch_too_small(spark):
    cells = sk.iblt(spark.range(200), "id", 8)
    _, empty = sk.iblt_entries(cells, 8)
    assert not empty


def test_invertible_sketches_double(spark):
    a, b = spark.range(0, 900), spark.range(300, 1000)
    got = sk.iblt_difference(a, b, "id", 8).collect()
    assert sorted((r.x, r.side) for r in got) == [*((x, 1) for x in range(300)), *((x, -1) for x in range(900, 1000))]


def test_bloom_filters_of_any_size(spark):
    n = 2_500_000  # over 2^24 bits
    held = spark.range(0, n).withColumnRenamed("id", "x")
    asked = spark.range(0, 2 * n, 97).withColumnRenamed("id", "x")
    rates = sk.bloom_of(held, "x", n, 0.01).mark(asked, "x", "hit").groupBy((F.col("x") < n).alias("member")).agg(F.avg(F.col("hit").cast("int")).alias("r"))
    got = {r.member: r.r for r in rates.collect()}
    assert got[True] == 1.0 and got[False] < 0.03


def test_bloom_union(spark):
    a, b = (sk.bloom_of(spark.range(i * 100, i * 100 + 100).union(spark.createDataFrame([(None,)], "id long")), "id", 200, 0.01) for i in (0, 1))
    got = a.union(b).mark(spark.range(200), "id", "hit")
    assert got.filter("hit").count() == 200
    assert a.mark(spark.createDataFrame([(None,)], "id long"), "id", "hit").first().hit is False
    with pytest.raises(ValueError):
        a.union(sk.bloom_of(spark.range(5), "id", 5, 0.5))


def test_gcd_takes_as_many_steps_as_it_needs(spark):
    from keystrata.functions.vectors import gcd

    a, b = 1, 1
    while b < 2**62:
        a, b = b, a + b
    rows = [(b, a), (-12, 18), (0, 7), (7, 0), (6 * b // 7, 6), (2**62, 2**40 * 3)]
    import math

    got = spark.createDataFrame(rows, "a long, b long").select(gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in got] == [math.gcd(*r) for r in rows]


def test_a_subquery_of_several_rows_is_an_error(spark):
    q = ObjectQuery(spark.range(5))
    more = lambda x, one: x > one
    assert q.against("id", spark.range(3, 4), more).result().count() == 1 and q.against("id", spark.range(0), more).result().count() == 0
    with pytest.raises(Exception, match="several rows"):
        q.against("id", spark.range(2), more).result().count()


def test_positional_numbers(spark):
    from keystrata.functions import positional as ps

    r, base = random.Random(3), 1000
    pairs = [(r.randrange(10**15), r.randrange(10**9)) for _ in range(50)] + [(0, 0), (10**15 - 1, 1)]
    rows = [(ky.to_digits(a, base), ky.to_digits(b, base)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = df.select(ps.plus(a, b, base).alias("p"), ps.minus(a, b, base).alias("m"), ps.times(a, b, base).alias("t"), ps.divided(a, 77, base).alias("d")).collect()
    for (x, y), g, (dx, dy) in zip(pairs, got, rows, strict=True):
        wide = base ** max(len(dx), len(dy))
        assert (ky.from_digits(g.p, base), ky.from_digits(g.m, base)) == ((x + y) % wide, (x - y) % wide)
        assert (ky.from_digits(g.t, base), ky.from_digits(g.d, base)) == (x * y, x // 77)
    big = spark.createDataFrame([(x,) for x, _ in pairs], "x long").select(ps.decimal_text(ps.digits_of(F.col("x"), base, 6), 3).alias("s")).collect()
    assert [r.s for r in big] == [str(x) for x, _ in pairs]


def test_ring_distance(spark):
    r = random.Random(8)
    pairs = [(f"{r.getrandbits(128):032x}", f"{r.getrandbits(128):032x}") for _ in range(40)] + [("0" * 32, "f" * 32), ("f" * 32, "0" * 32), ("8" * 32, "8" * 32)]
    got = spark.createDataFrame(pairs, "a string, b string").select(ky.ring_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [x.d for x in got] == [f"{(int(b, 16) - int(a, 16)) % ky.RING:032x}" for a, b in pairs]


def test_primes_in_arrays():
    import numpy as np

    r = random.Random(2)
    n = [*range(-3, 3000), *(r.randrange(2**32) for _ in range(3000)), 2**32 - 5, 2**32 - 1, 2**61 - 1, 3215031751, 25326001, 4759123141, (2**31 - 1) * (2**31 + 11)]
    assert ky.primes(np.array(n, "i8")).tolist() == [ky.prime(x) for x in n]


def test_packed_deltas(spark):
    from keystrata.functions.vectors import packed, unpacked

    lists = [[3, 4, 9, 1000], [0], [], [5, 5, 5], list(range(50))]
    rows = spark.createDataFrame([(x,) for x in lists], "k array<long>")
    width, bits = packed(F.col("k"))
    got = rows.select(width.alias("w"), bits.alias("b")).select(unpacked(F.col("w"), F.col("b")).alias("k")).collect()
    assert [r.k for r in got] == lists


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_values_with_a_hot_key(spark, partitions):
    from keystrata.operators import ranks

    r = random.Random(partitions)
    data = [(0 if i % 3 else r.randrange(6), i, r.choice([None, r.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(data, "k int, at int, v int")
    got = ranks.running(df, ["k", "at"], {"n": (F.sum, F.lit(1)), "m": (F.max, F.struct("k", "v"))}, after={"next": (F.min, F.struct("k", "at"))}, partitions=partitions)
    rows = got.withColumns({"m": ranks.of_key("m", "k", "v"), "next": ranks.of_key("next", "k", "at")}).collect()
    order = sorted(data, key=lambda x: x[:2])
    for i, row in enumerate(sorted(rows, key=lambda x: (x.k, x.at))):
        own = [x for x in order[: i + 1] if x[0] == row.k]
        later = [x[1] for x in order[i + 1 :] if x[0] == row.k]
        assert (row.n, row.m, row.next) == (i + 1, max((x[2] for x in own if x[2] is not None), default=None), min(later, default=None))
    placed = {(x.k, x.at): x.p for x in ranks.within(df.select("k", "at"), ["k"], ["at"], "p").collect()}
    assert all(placed[x[:2]] == sum(y[0] == x[0] and y[1] <= x[1] for y in data) for x in data)
    import statistics

    assert {x.k: x.m for x in ranks.median(df, ["k"], "v", "m").collect()} == {k: statistics.median(x[2] for x in data if x[0] == k and x[2] is not None) for k in {x[0] for x in data if x[2] is not None}}


def test_lists_by_parts(spark):
    df = spark.createDataFrame([([4, 6, 3, 9],), ([1],), ([],)], "a array<int>")
    a = F.col("a")
    got = df.select(ls.take_with(a, lambda x: x % 3 == 0).alias("t"), ls.partition3(a, lambda x: x - 4).alias("p")).collect()
    assert got[0].t == (6, [4, 3, 9]) and got[1].t is None and got[2].t is None and got[0].p == ([3], [4], [6, 9])
