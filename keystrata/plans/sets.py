"""Interval algebra, list updates and set operations between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import intervals as iv
from keystrata.operators import lists as ls
from keystrata.plans.filters import _flat
from keystrata.plans.registry import query, table

SPANS = "SELECT o_custkey AS g, o_orderkey AS lo, o_orderkey + CAST(o_totalprice AS BIGINT) // 60 AS hi FROM orders"
SPANS_B = "SELECT o_custkey AS g, o_orderkey + 300 AS lo, o_orderkey + 300 + CAST(floor(o_totalprice) AS BIGINT) % 900 + 1 AS hi FROM orders WHERE o_orderkey % 3 = 0"


def spans(spark, d):
    """Overlapping key intervals of each customer."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.floor(F.round("o_totalprice") / 60)).alias("hi"))


def spans_b(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    lo = F.col("o_orderkey") + 300
    return o.select(F.col("o_custkey").alias("g"), lo.alias("lo"), (lo + F.floor("o_totalprice") % 900 + 1).alias("hi"))


ISLANDS = """SELECT g, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({}))) GROUP BY g, island"""


@query("u1_interval_union", ISLANDS.format(SPANS))
def u1(spark, d):
    return iv.union(spans(spark, d), ["g"], "lo", "hi")


@query("u2_interval_intersection", f"SELECT g, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({ISLANDS.format(SPANS)}) a JOIN ({ISLANDS.format(SPANS_B)}) b USING (g) WHERE greatest(a.lo, b.lo) <= least(a.hi, b.hi)")
def u2(spark, d):
    return iv.intersection(iv.union(spans(spark, d), ["g"], "lo", "hi"), iv.union(spans_b(spark, d), ["g"], "lo", "hi"), ["g"], "lo", "hi")


@query(
    "u3_interval_difference",
    f"""WITH a AS ({SPANS}), b AS ({SPANS_B}), p AS (SELECT g, pt, sum(x) AS x, sum(y) AS y FROM (SELECT g, lo AS pt, 1 AS x, 0 AS y FROM a UNION ALL SELECT g, hi, -1, 0 FROM a UNION ALL SELECT g, lo, 0, 1 FROM b UNION ALL SELECT g, hi, 0, -1 FROM b) GROUP BY 1, 2),
    q AS (SELECT g, pt AS lo, lead(pt) OVER w AS hi, sum(x) OVER w AS x, sum(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY g ORDER BY pt)) {ISLANDS.format('SELECT g, lo, hi FROM q WHERE x > 0 AND y = 0 AND hi IS NOT NULL')}""",
)
def u3(spark, d):
    return iv.difference(spans(spark, d), spans_b(spark, d), ["g"], "lo", "hi")


@query(
    "u4_interval_relations",
    f"""SELECT a.g, a.lo AS alo, coalesce(bool_or(a.lo >= b.lo AND a.hi <= b.hi), false) AS subset, coalesce(bool_or(a.hi = b.lo OR b.hi = a.lo), false) AS adjacent,
    coalesce(bool_or(a.hi < b.lo), false) AS left_of FROM ({SPANS}) a LEFT JOIN ({SPANS_B}) b USING (g) GROUP BY a.g, a.lo, a.hi""",
)
def u4(spark, d):
    """Whether an interval lies in, touches, or is left of some interval of the other set, for all customers without their pairs."""
    return iv.relations(spans(spark, d), spans_b(spark, d), ["g"], "lo", "hi").select("g", F.col("lo").alias("alo"), "subset", "adjacent", "left_of")


@query("u5_constructors", "SELECT o_orderkey, false AS open_, false AS half, o_orderkey = 40 AS single, true AS whole, o_orderkey > 30 AND o_orderkey < 50 AS between_ FROM orders")
def u5(spark, d):
    k = F.col("o_orderkey")
    kinds = {"open_": iv.Interval(40, 40, False, False), "half": iv.Interval(40, 40, True, False), "single": iv.Interval(40, 40), "whole": iv.Interval(None, None), "between_": iv.Interval(30, 50, False, False)}
    return table(spark, d, "orders").select("o_orderkey", *(v.test(k).alias(n) for n, v in kinds.items()))


@query("u6_interval_split", "SELECT i AS part, 1000 * i // 7 AS lo, 1000 * (i + 1) // 7 AS hi, (SELECT count(*) FROM orders WHERE o_orderkey >= 1000 * i // 7 AND o_orderkey < 1000 * (i + 1) // 7) AS n FROM (SELECT unnest(range(7)) AS i)")
def u6(spark, d):
    """Seven parts of an interval, and the rows of each."""
    parts = iv.split(0, 1000, 7)
    part = F.coalesce(*(F.when(p.test(F.col("o_orderkey")), F.lit(i)) for i, p in enumerate(parts)))
    n = table(spark, d, "orders").filter("o_orderkey >= 0 AND o_orderkey < 1000").groupBy(part.cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    bounds = spark.createDataFrame([(i, p.lo, p.hi) for i, p in enumerate(parts)], "part long, lo long, hi long")
    return bounds.join(n, "part", "left").select("part", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "u7_list_add_remove",
    """SELECT l_orderkey, array_to_string(list_concat([9], CASE WHEN list_position(p, p[1] % 5) IS NULL THEN p ELSE list_concat(p[1:list_position(p, p[1] % 5) - 1], p[list_position(p, p[1] % 5) + 1:]) END), ',') AS part
    FROM (SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1)""",
)
def u7(spark, d):
    """Prepend 9, then take out the first occurrence of a number below 5."""
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s")).select("l_orderkey", F.transform("s", lambda x: x["l_partkey"] % 5).alias("p"))
    nine = F.array(F.lit(9).cast("long"))
    return rows.select("l_orderkey", _flat(ls.add_then_remove(F.col("p"), nine, F.array(F.element_at("p", 1) % 5))).alias("part"))


@query("u8_list_subtract", "SELECT l_orderkey, array_to_string(list_filter(p, lambda x: x NOT IN (1, 3)), ',') AS part FROM (SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1)")
def u8(spark, d):
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s")).select("l_orderkey", F.transform("s", lambda x: x["l_partkey"] % 5).alias("p"))
    return rows.select("l_orderkey", _flat(ls.without_all(F.col("p"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))).alias("part"))


@query("u9_set_equality", "SELECT count(*) FILTER (WHERE a = b) AS equal, count(*) AS n FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey % 3))) AS a, list_sort(list_distinct(list(l_suppkey % 3))) AS b FROM lineitem GROUP BY 1)")
def u9(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 3).alias("a"), F.collect_set(F.col("l_suppkey") % 3).alias("b"))
    return sets.agg(F.count_if(ls.same_set(F.col("a"), F.col("b"))).alias("equal"), F.count(F.lit(1)).alias("n"))


@query("u10_distinct_union", "SELECT l_suppkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def u10(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("k"))).distinct()


@query("u11_bag_union", "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT o_custkey FROM orders)")
def u11(spark, d):
    both = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("u12_set_difference", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u12(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().join(table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("u12_bag_difference", "SELECT l_suppkey % 7 AS k FROM lineitem EXCEPT ALL SELECT o_custkey % 7 FROM orders")
def u12_bag(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("k")).exceptAll(table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("k")))


@query("u13_without_included", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')")
def u13(spark, d):
    used = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")
