"""Window-shaped computations, sorts, limits and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.operators.ranks import numbered, within
from keystrata.operators.sketch import hashes
from keystrata.plans.oracle import hex_part
from keystrata.plans.registry import query, table


@query("n1_newest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def n1(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("n2_key_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank, ntile(4) OVER (ORDER BY o_orderkey) AS quarter FROM orders")
def n2(spark, d):
    """Ranks from a range sort; quarters follow from rank and count."""
    rows, total = numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    small, extra = total // 4, total % 4
    cut = extra * (small + 1)
    r = F.col("rank")
    quarter = F.when(r < cut, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - cut) / max(small, 1))) + 1
    return rows.select("o_orderkey", (r + 1).alias("rank"), quarter.cast("long").alias("quarter"))


@query("n3_running_count", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders")
def n3(spark, d):
    return within(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "run")


@query("n4_position_weights", "SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) * rn) // sum(rn) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) GROUP BY 1")
def n4(spark, d):
    """Averages in whole hundredths: a sum of fractions would depend on its order."""
    rows = within(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "rn")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return rows.groupBy("o_custkey").agg(F.sum(cents * F.col("rn")).alias("x"), F.sum("rn").alias("n")).select("o_custkey", F.expr("x div n").alias("cents"))


SLOTS = "SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS slot, sum(value) AS v FROM events GROUP BY 1, 2"


def slots(spark, d):
    """Six-hour sums of each event type."""
    from keystrata.operators.series import slot_of

    return table(spark, d, "events").groupBy("event_type", slot_of("ts", "6 hours").alias("slot")).agg(F.sum("value").alias("v"))


@query("n5_last_slots", f"SELECT event_type, slot, round(v, 6) AS v FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY slot DESC) r FROM ({SLOTS})) WHERE r <= 5")
def n5(spark, d):
    r = F.dense_rank().over(W.partitionBy("event_type").orderBy(F.desc("slot")))
    return slots(spark, d).withColumn("r", r).filter("r <= 5").select("event_type", "slot", F.round("v", 6).alias("v"))


@query(
    "n6_fill_gaps",
    f"""WITH s AS ({SLOTS}), b AS (SELECT event_type, min(slot) lo, max(slot) hi FROM s GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS slot FROM b)
    SELECT event_type, slot, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY slot), 6) AS v FROM g LEFT JOIN s USING (event_type, slot)""",
)
def n6(spark, d):
    from keystrata.operators.series import fill

    return fill(slots(spark, d), ["event_type"], "slot", ["v"], "6 hours", "last").withColumn("v", F.round("v", 6))


@query("n7_slot_offsets", f"SELECT event_type, slot, round(lag(v) OVER w, 6) AS before, round(lead(v) OVER w, 6) AS after FROM ({SLOTS}) WINDOW w AS (PARTITION BY event_type ORDER BY slot)")
def n7(spark, d):
    by = W.partitionBy("event_type").orderBy("slot")
    return slots(spark, d).select("event_type", "slot", F.round(F.lag("v").over(by), 6).alias("before"), F.round(F.lead("v").over(by), 6).alias("after"))


@query(
    "n8_change_percent",
    f"SELECT event_type, slot, round(CASE WHEN p IS NULL OR p = 0 THEN 100.0 ELSE abs(v - p) * 100.0 / abs(p) END, 4) AS change FROM (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY slot) AS p FROM ({SLOTS}))",
)
def n8(spark, d):
    """Absolute change against the slot before; 100 where that is unknown or 0."""
    p = F.lag("v").over(W.partitionBy("event_type").orderBy("slot"))
    rows = slots(spark, d).withColumn("p", p)
    change = F.when(F.col("p").isNull() | (F.col("p") == 0), 100.0).otherwise(F.abs(F.col("v") - F.col("p")) * 100.0 / F.abs("p"))
    return rows.select("event_type", "slot", F.round(change, 4).alias("change"))


@query("l1_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def l1(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


@query("l2_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def l2(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("l2_last_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def l2_last(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_totalprice")


@query("l3_order_and_range", "SELECT p_partkey, p_name FROM part WHERE p_size > 5 ORDER BY p_name, p_partkey LIMIT 30 OFFSET 10")
def l3(spark, d):
    from keystrata.operators.objects import ObjectQuery

    return ObjectQuery(table(spark, d, "part")).where("p_size > 5").order("p_name", "p_partkey").range(10, 40).result("p_partkey", "p_name")


@query("l4_limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def l4(spark, d):
    return table(spark, d, "customer").orderBy("c_custkey").offset(100).limit(50).select("c_custkey", "c_name")


def drawn(column: str, seed: int):
    """A random order that a seed repeats."""
    return F.md5(F.concat_ws(":", column, F.lit(seed)).cast("binary"))


@query("l5_random_subset", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':11') LIMIT 10")
def l5(spark, d):
    """Ten random rows; the seed makes them repeatable."""
    return table(spark, d, "customer").orderBy(drawn("c_custkey", 11)).limit(10).select("c_custkey")


@query("l5_shuffle_and_pop", "SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':5')) AS place FROM customer QUALIFY place > 1")
def l5_shuffle(spark, d):
    """All rows in a random order, without the first, which is popped."""
    rows, _ = numbered(table(spark, d, "customer").select("c_custkey", drawn("c_custkey", 5).alias("r")), ["r", "c_custkey"])
    return rows.filter("rank > 0").select("c_custkey", (F.col("rank") + 1).alias("place"))


@query("l6_random_article", f"SELECT doc_id FROM documents ORDER BY {hex_part('doc_id', 0)} % 7 <> 2, md5(doc_id || ':3') LIMIT 1")
def l6(spark, d):
    """One random page of a bucket, or of all pages where the bucket is empty."""
    other = hashes(F.col("doc_id"), 1, "md5")[0] % 7 != 2
    return table(spark, d, "documents").select("doc_id").orderBy(other, drawn("doc_id", 3)).limit(1)


@query("l7_split_keys", "SELECT i, i * 1000000 // 8 AS key FROM (SELECT unnest(range(8)) AS i)")
def l7(spark, d):
    """Evenly spaced keys of a ring of a million."""
    return spark.range(8).select(F.col("id").alias("i"), F.floor(F.col("id") * 1000000 / 8).alias("key"))


@query("l8_min_max", "SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax * 500, 20) AS low, greatest(l_quantity, l_tax * 500, 20) AS high FROM lineitem")
def l8(spark, d):
    q, t = F.col("l_quantity"), F.col("l_tax") * 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least(q, t, F.lit(20.0)).alias("low"), F.greatest(q, t, F.lit(20.0)).alias("high"))


@query("l9_ring_order", "SELECT s_name, s_suppkey FROM supplier ORDER BY s_suppkey")
def l9(spark, d):
    return table(spark, d, "supplier").select("s_name", "s_suppkey").orderBy("s_suppkey")
