"""Point, range, chunk, quorum and snapshot reads; writes, deletes and bulk moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import store as st
from keystrata.plans.registry import query, table


@query("s1_point_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def s1(spark, d):
    return st.point(table(spark, d, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_totalprice")


REPLICAS = """SELECT o_orderkey AS k, r, o_custkey + CASE WHEN (o_orderkey + r) % 5 = 0 THEN 0 ELSE 1 END AS version,
    o_totalprice + CASE WHEN (o_orderkey + r) % 5 = 0 THEN 0 ELSE 1 END AS value
    FROM orders, (VALUES (0), (1), (2)) t(r) WHERE NOT (o_orderkey % 11 = 0 AND r > 0) AND NOT (o_orderkey % 7 = 0 AND r = 2)"""


def replicas(spark, d):
    """Three copies of each order; some are missing and some are one version behind."""
    k = F.col("o_orderkey")
    fresh = F.when((k + F.col("r")) % 5 == 0, 0).otherwise(1)
    rows = table(spark, d, "orders").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.filter(~((k % 11 == 0) & (F.col("r") > 0)) & ~((k % 7 == 0) & (F.col("r") == 2)))
    return rows.select(k.alias("k"), "r", (F.col("o_custkey") + fresh).alias("version"), (F.col("o_totalprice") + fresh).alias("value"))


@query("s2_quorum_read", f"SELECT k, arg_max(value, version) AS value, max(version) AS version, count(*) AS replies FROM ({REPLICAS}) GROUP BY k HAVING count(*) >= 2")
def s2(spark, d):
    return st.quorum(replicas(spark, d), "k", "version", "value", 3)


@query("s3_consensus_read", f"SELECT k, version, value FROM (SELECT k, max(version) AS version, arg_max(value, version) AS value FROM ({REPLICAS}) GROUP BY k) WHERE k BETWEEN 100 AND 300")
def s3(spark, d):
    return st.latest(replicas(spark, d).filter(st.in_range("k", 100, 300)), ["k"], "version", ["value"])


for _name, _lo, _hi, _where in (("inner", 500, 900, "BETWEEN 500 AND 900"), ("wrapped", 14000, 120, ">= 14000 OR o_orderkey <= 120"), ("whole_ring", 5, 5, "IS NOT NULL")):

    @query(f"s4_range_read_{_name}", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey {_where}")
    def s4(spark, d, lo=_lo, hi=_hi):
        return table(spark, d, "orders").filter(st.in_range("o_orderkey", lo, hi)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s5_snapshot_scan", "SELECT user_id, event_id AS version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def s5(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_id", "version")
    return st.latest(rows, ["user_id"], "version", ["event_type", "value"])


@query("s6_filtered_scan", "SELECT c_custkey, upper(c_mktsegment) AS segment, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_acctbal > 1000 AND c_nationkey IN (1, 3, 5)")
def s6(spark, d):
    rows = table(spark, d, "customer").filter((F.col("c_acctbal") > 1000) & F.col("c_nationkey").isin(1, 3, 5))
    return rows.select("c_custkey", F.upper("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 2, 2).alias("twice"))


@query(
    "s7_chunk_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 700 OR o_orderkey <= 300 ORDER BY CASE WHEN o_orderkey >= 900 THEN 0 ELSE 1 END, o_orderkey LIMIT 250",
)
def s7(spark, d):
    return st.chunk(table(spark, d, "orders"), "o_orderkey", 900, 700, 300, 250).select("o_orderkey", "o_totalprice")


@query(
    "s7_chunk_remainder",
    """SELECT max(o_orderkey) + 1 AS next_lo, CAST(1200 AS BIGINT) AS hi, count(*) AS taken FROM
    (SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 1200 ORDER BY o_orderkey LIMIT 400)""",
)
def s7_rest(spark, d):
    """What a chunk leaves of its interval: from after its last key on."""
    got = st.chunk(table(spark, d, "orders"), "o_orderkey", 100, 100, 1200, 400)
    return got.agg((F.max("o_orderkey") + 1).alias("next_lo"), F.lit(1200).cast("long").alias("hi"), F.count(F.lit(1)).alias("taken"))


@query("s8_chunk_raw", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100 ORDER BY c_custkey LIMIT 40")
def s8(spark, d):
    return st.chunk(table(spark, d, "customer"), "c_custkey", 100, 100, 1 << 40, 40).select("c_custkey", "c_name")


@query("s9_entries_elements", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 5, 8, 900, 1001)")
def s9(spark, d):
    return st.points(table(spark, d, "orders"), "o_orderkey", [3, 5, 8, 900, 1001]).select("o_orderkey", "o_custkey")


@query("s9_entries_predicate", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def s9p(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 200000 AND o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")


@query("s10_fold_ascending", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key FROM (SELECT * FROM orders WHERE o_orderkey BETWEEN 50 AND 5000 ORDER BY o_orderkey LIMIT 300)")
def s10(spark, d):
    rows = st.fold_rows(table(spark, d, "orders"), "o_orderkey", 50, 5000, 300)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last_key"))


@query("s11_fold_descending", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS last_key FROM (SELECT * FROM orders WHERE o_orderkey BETWEEN 50 AND 5000 ORDER BY o_orderkey DESC LIMIT 300)")
def s11(spark, d):
    rows = st.fold_rows(table(spark, d, "orders"), "o_orderkey", 50, 5000, 300, descending=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("last_key"))


@query("s12_unordered_fold", "SELECT count(*) AS n, sum(n_nationkey) AS keys FROM nation")
def s12(spark, d):
    return table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"))


CHANGES = "SELECT o_orderkey, o_custkey + 100000 AS version, o_totalprice * 2 AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 10000000, CAST(1 AS BIGINT), 1.5 FROM orders WHERE o_orderkey % 50 = 0"


def changes(spark, d):
    o = table(spark, d, "orders")
    update = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 100000).alias("version"), (F.col("o_totalprice") * 2).alias("value"))
    new = o.filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(1).cast("long").alias("version"), F.lit(1.5).alias("value"))
    return update.unionByName(new)


@query(
    "s14_write_upsert",
    f"""SELECT o_orderkey, max(version) AS version, round(arg_max(value, version), 2) AS value FROM
    (SELECT o_orderkey, o_custkey AS version, o_totalprice AS value FROM orders UNION ALL {CHANGES}) GROUP BY o_orderkey""",
)
def s14(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("version"), F.col("o_totalprice").alias("value"))
    out = st.upsert(base, changes(spark, d), "o_orderkey", "version", ["value"])
    return out.withColumn("value", F.round("value", 2))


@query(
    "s15_guarded_write",
    """SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS version,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS value, CASE WHEN o_orderstatus = 'F' THEN 'denied' ELSE 'ok' END AS status FROM orders""",
)
def s15(spark, d):
    """A write raises the version unless the entry is locked; a denial is shown."""
    locked = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") + F.when(locked, 0).otherwise(1)).alias("version"),
        F.when(locked, F.col("o_totalprice")).otherwise(0.0).alias("value"),
        F.when(locked, "denied").otherwise("ok").alias("status"),
    )


DOOMED = "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT n_nationkey + 90000000 FROM nation"


def doomed(spark, d):
    hit = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return hit.unionByName(table(spark, d, "nation").select((F.col("n_nationkey") + 90000000).cast("long").alias("o_orderkey")))


@query("s16_delete", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN ({DOOMED})")
def s16(spark, d):
    return st.delete(table(spark, d, "orders"), doomed(spark, d), "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "s16_delete_status",
    f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 'undef' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM ({DOOMED})) x LEFT JOIN orders o USING (o_orderkey) GROUP BY 1",
)
def s16s(spark, d):
    return st.delete_status(table(spark, d, "orders"), doomed(spark, d), "o_orderkey")


@query("s17_delete_where", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0 OR c_custkey BETWEEN 20 AND 60)")
def s17(spark, d):
    return table(spark, d, "customer").filter(~((F.col("c_acctbal") < 0) | st.in_range("c_custkey", 20, 60))).select("c_custkey", "c_name")


@query("s18_split_and_add", "SELECT c_custkey, CASE WHEN c_custkey > 900 OR c_custkey < 100 THEN 'moved' ELSE 'kept' END AS part FROM customer")
def s18(spark, d):
    rows = table(spark, d, "customer").select("c_custkey")
    moved = (F.col("c_custkey") > 900) | (F.col("c_custkey") < 100)
    return rows.select("c_custkey", F.when(moved, "moved").otherwise("kept").alias("part"))


@query(
    "s23_partitioned_import",
    "SELECT p, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, ntile(5) OVER (ORDER BY p_partkey) AS p FROM part) GROUP BY p",
)
def s23(spark, d):
    """Five ranges of equal size from a range sort; counts of the sorted partitions replace a numbering of all rows."""
    from keystrata.operators.ranks import numbered

    rows, total = numbered(table(spark, d, "part").select("p_partkey"), ["p_partkey"])
    small, extra = total // 5, total % 5
    cut = extra * (small + 1)
    part = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (small + 1))).otherwise(F.lit(extra) + F.floor((F.col("rank") - cut) / max(small, 1))) + 1
    return rows.withColumn("p", part.cast("long")).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@query("s24_extent_scan", "SELECT s_suppkey, s_name FROM supplier")
def s24(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name")


@query("s25_scan_n", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey >= 37 ORDER BY c_custkey LIMIT 20")
def s25(spark, d):
    return table(spark, d, "customer").filter("c_custkey >= 37").orderBy("c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query(
    "s26_service_info",
    "SELECT count(*) AS nodes, count(*) FILTER (WHERE s_acctbal >= 0) AS answering, round(coalesce(sum(s_acctbal) FILTER (WHERE s_acctbal >= 0), 0), 2) AS total_load FROM supplier",
)
def s26(spark, d):
    up = F.col("s_acctbal") >= 0
    return table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(up).alias("answering"), F.round(F.coalesce(F.sum(F.when(up, F.col("s_acctbal"))), F.lit(0.0)), 2).alias("total_load"))
