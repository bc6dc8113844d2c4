"""Closures and link expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators.graph import closure
from keystrata.plans.registry import query, table
from keystrata.sources.scratch import materialize

EDGES = "SELECT DISTINCT l_partkey AS src, (l_partkey * 31 + l_suppkey * 7) % (SELECT count(*) FROM part) + 1 AS dst FROM lineitem"


def edges(spark, d):
    """Links between parts that all items derive, written once for all rounds; they have cycles."""
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "lineitem").join(F.broadcast(n))
    links = rows.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % F.col("n") + 1).alias("dst"))
    return materialize(links.distinct(), "edges")


@query("g1_category_closure", f"WITH RECURSIVE e AS ({EDGES}), c(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c")
def g1(spark, d):
    return closure(edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node"))).select("node")


@query("g2_child_map_closure", f"WITH RECURSIVE e AS ({EDGES}), c(node) AS (SELECT src FROM e WHERE src <= 5 UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT count(*) AS reached, CAST(sum(node) AS BIGINT) AS folded FROM c")
def g2(spark, d):
    e = edges(spark, d)
    start = e.filter("src <= 5").select(F.col("src").alias("node"))
    return closure(e, start).agg(F.count(F.lit(1)).alias("reached"), F.sum("node").alias("folded"))


@query(
    "g3_bounded_expansion",
    f"WITH RECURSIVE e AS ({EDGES}), c(node, level) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.dst, level + 1 FROM c JOIN e ON e.src = c.node WHERE level < 3) SELECT node, min(level) AS level FROM c GROUP BY node",
)
def g3(spark, d):
    return closure(edges(spark, d), spark.range(7, 8).select(F.col("id").alias("node")), 3)


@query("g4_tree_maps", "SELECT r_name, count(DISTINCT n_name) AS children, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def g4(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    rows = r.join(n, r.r_regionkey == n.n_regionkey).join(c.select("c_nationkey").distinct(), F.col("c_nationkey") == n.n_nationkey)
    names = F.sort_array(F.collect_set("n_name"))
    return rows.groupBy("r_name").agg(F.size(names).cast("long").alias("children"), F.array_join(names, ",").alias("names"))


@query("g5_members_of_set", "SELECT DISTINCT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def g5(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("c_nationkey"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").join(o, "c_custkey", "left_semi").select("c_custkey").distinct()
