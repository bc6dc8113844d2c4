"""Sketches: bounded histograms, Bloom and counting filters, invertible sketches, Merkle counters, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import sketch as sk
from keystrata.plans.oracle import HISTOGRAM, bloom_sql, bounded_sql, hex_part, merge_once
from keystrata.plans.registry import query, table


def entries(df, *by):
    """A row for each of a histogram's entries."""
    return df.select(*by, F.explode("h").alias("e")).select(*by, F.round("e.x", 4).alias("x"), F.col("e.n").alias("n"))


def entries_sql(h: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"SELECT {group}round(e.x, 4) AS x, e.n AS n FROM (SELECT {group}unnest(h) AS e FROM ({h}))"


@query("a14_bounded_histogram", entries_sql(bounded_sql("SELECT l_extendedprice AS x FROM lineitem", "", 20)))
def a14(spark, d):
    return entries(sk.bounded(table(spark, d, "lineitem"), [], F.col("l_extendedprice"), 20))


@query("a14_whole_numbers", entries_sql(bounded_sql("SELECT l_partkey AS x FROM lineitem", "", 12, whole=True)))
def a14_whole(spark, d):
    """Whole values stay whole: means are divided without a rest."""
    return entries(sk.bounded(table(spark, d, "lineitem"), [], F.col("l_partkey"), 12, whole=True))


FLAGGED = "SELECT l_returnflag AS g, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')"


@query(
    "a15_histogram_merge",
    f"""WITH h AS ({bounded_sql(FLAGGED, 'g', 10)}), m AS (SELECT list_reduce([a.h, list_transform(b.h, lambda e: {{'x': e.x, 'n': e.n * 2}})], lambda a, h: list_reduce(list_concat([list_sort(list_concat(a, h))],
    list_transform(range(10), lambda _: CAST([] AS {HISTOGRAM.format('DOUBLE')}))), lambda b, _: {merge_once('b', 10, False)})) AS h FROM (SELECT h FROM h WHERE g = 'R') a, (SELECT h FROM h WHERE g = 'A') b)
    {entries_sql("SELECT list_filter(list_transform(h, lambda e: {'x': e.x, 'n': e.n // 3}), lambda e: e.n > 0) AS h FROM m")}""",
)
def a15(spark, d):
    """Two bounded histograms, the second with twice the weight, merged and normalised by three."""
    h = sk.bounded(table(spark, d, "lineitem").filter("l_returnflag IN ('A', 'R')"), ["l_returnflag"], F.col("l_quantity"), 10)
    first, second = (h.filter(f"l_returnflag = '{f}'").select(F.col("h").alias(f)) for f in "RA")
    both = first.crossJoin(second)  # a row each
    weighted = "transform(A, e -> named_struct('x', e.x, 'n', e.n * 2))"
    return entries(both.select(F.expr(sk.merged(f"array(R, {weighted})", 10)).alias("h")).select(F.expr(sk.normalized("h", 3)).alias("h")))


RING = "SELECT (o_orderkey - 5000 + m) % m AS x FROM orders, (SELECT (max(o_orderkey) // 20000 + 1) * 20000 AS m FROM orders)"


@query("a17_ring_histogram", f"SELECT (e.x + 5000) % m AS key, e.n AS n FROM (SELECT unnest(h) AS e FROM ({bounded_sql(RING, '', 16, whole=True)})), (SELECT (max(o_orderkey) // 20000 + 1) * 20000 AS m FROM orders)")
def a17(spark, d):
    """A bounded histogram of keys by their distance from a base key around a ring of as many times 20,000 as hold all keys; its entries are keys again."""
    rows = table(spark, d, "orders").select("o_orderkey")
    ring = F.broadcast(rows.agg(((F.floor(F.max("o_orderkey") / 20000) + 1) * 20000).alias("m")))
    h = sk.bounded(rows.join(ring), [], F.pmod(F.col("o_orderkey") - 5000, F.col("m")), 16, whole=True)
    return h.join(ring).select(F.explode("h").alias("e"), "m").select(((F.col("e.x") + 5000) % F.col("m")).alias("key"), F.col("e.n").alias("n"))


@query("a29_merkle_counters", "SELECT (SELECT count(*) FROM orders) AS items, (SELECT count(DISTINCT o_orderkey // 256) FROM orders) AS leaves, (SELECT count(DISTINCT o_orderkey // 4096) FROM orders) AS inner_nodes")
def a29(spark, d):
    levels = sk.merkle_levels(table(spark, d, "orders"), "o_orderkey", "o_custkey", 0, 1 << 20, 16, 3)
    leaves = levels[0].agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("leaves"))
    return leaves.join(levels[1].agg(F.count(F.lit(1)).alias("inner_nodes"))).select("items", "leaves", "inner_nodes")


@query("a30_bloom_rate", f"SELECT x % 3 = 0 AS member, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM ({bloom_sql('SELECT c_custkey AS x FROM customer WHERE c_custkey % 3 = 0', 'SELECT c_custkey AS x FROM customer', 0.05)}) GROUP BY 1")
def a30(spark, d):
    """A filter over one customer in three: it holds all of them, and some of the others by chance."""
    c = table(spark, d, "customer").select("c_custkey")
    held = c.filter("c_custkey % 3 = 0")
    hit = sk.bloom_of(held, "c_custkey", held.count(), 0.05, "md5").mark(c, "c_custkey", "hit")
    return hit.groupBy((F.col("c_custkey") % 3 == 0).alias("member")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("a31_counting_bloom", f"SELECT p AS pos, count(*) AS n FROM (SELECT ({hex_part('c_custkey', 0)} % 16384 + i * ({hex_part('c_custkey', 1)} % 16383 + 1)) % 16384 AS p FROM customer, (SELECT unnest(range(4)) AS i) WHERE c_custkey % 2 = 1) GROUP BY 1")
def a31(spark, d):
    """Additions less removals: what was removed again leaves nothing."""
    c = table(spark, d, "customer").select("c_custkey")
    both = c.withColumn("s", F.lit(1)).unionByName(c.filter("c_custkey % 2 = 0").withColumn("s", F.lit(-1)))
    return sk.counting_bloom(both, "c_custkey", 1 << 14, 4, F.col("s"), "md5")


@query("a32_invertible_sketch", "SELECT o_orderkey AS x, CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE -1 END AS side FROM orders WHERE (o_orderkey % 101 = 0) <> (o_orderkey % 103 = 0)")
def a32(spark, d):
    """The keys in which two stores differ, from sketches that double until they hold their difference."""
    a, b = (table(spark, d, "orders").select("o_orderkey").filter(f"o_orderkey % {m} <> 0") for m in (103, 101))
    return sk.iblt_difference(a, b, "o_orderkey", 64).select("x", F.col("side").cast("int").alias("side"))


@query("a33_clustering")
def a33(spark, d):
    """Agglomerative clusters of all points of each label, by Arrow groups."""
    import numpy as np
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        _, weights = sk.agglomerate(np.array(pdf.sort_values("vec_id")["v"].tolist(), float), 0.9)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "cluster": range(len(weights)), "weight": weights})

    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy("label").applyInPandas(merge, "label int, cluster long, weight double")


NEAREST = "list_transform(range(2, len(s) + 1), lambda j: s[j].x - s[j - 1].x)"
JOINED = "list_concat(s[1:i - 1], [{'x': (s[i].x * s[i].n + s[i + 1].x * s[i + 1].n) / (s[i].n + s[i + 1].n), 'n': s[i].n + s[i + 1].n}], s[i + 2:])"
STEP = f"list_transform([b], lambda s: CASE WHEN len(s) > 1 AND list_min({NEAREST}) <= 150 THEN list_transform([list_position({NEAREST}, list_min({NEAREST}))], lambda i: {JOINED})[1] ELSE s END)[1]"


@query(
    "a33_clusters_of_values",
    f"""SELECT c_nationkey, round(e.x, 6) AS centre, CAST(e.n AS BIGINT) AS weight FROM (SELECT c_nationkey, unnest(list_reduce(list_concat([p], list_transform(range(len(p)), lambda _: CAST([] AS STRUCT(x DOUBLE, n BIGINT)[]))), lambda b, _: {STEP})) AS e FROM
    (SELECT c_nationkey, list({{'x': c_acctbal, 'n': CAST(1 AS BIGINT)}} ORDER BY c_acctbal) AS p FROM customer GROUP BY c_nationkey))""",
)
def a33_values(spark, d):
    """Agglomerative clusters of each nation's balances: on a line the closest pair are neighbours, so that SQL can follow."""
    import numpy as np
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, weights = sk.agglomerate(np.sort(pdf["v"].to_numpy())[:, None], 150.0)
        return pd.DataFrame({"c_nationkey": pdf["c_nationkey"].iloc[0], "centre": centres[:, 0], "weight": np.array(weights, "i8")})

    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_acctbal").alias("v"))
    return rows.groupBy("c_nationkey").applyInPandas(merge, "c_nationkey int, centre double, weight long").withColumn("centre", F.round("centre", 6))
