"""Map-reduce, loads, histograms and quantiles, averages, mergeable counters and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.functions.vectors import merge_weighted
from keystrata.operators import crdt, mapreduce
from keystrata.operators.ranks import median, running, within
from keystrata.plans.registry import query, table

def counted():
    return F.count(F.lit(1)).alias("n")


@query("a1_grouping", "SELECT event_type AS k, count(*) AS n_values, sum(user_id) AS total FROM events GROUP BY event_type")
def a1(spark, d):
    """Values of a key are gathered; here only their number and sum are kept, which partial aggregation can do."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count("user_id").alias("n_values"), F.sum("user_id").alias("total"))


@query("a1_lists_join", "SELECT l_suppkey AS k, array_to_string(list(x ORDER BY x), ',') AS v FROM (SELECT l_suppkey, unnest([l_linenumber, l_linenumber + 10]) AS x FROM lineitem) GROUP BY 1")
def a1_lists(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.array("l_linenumber", F.col("l_linenumber") + 10).alias("v"))
    return mapreduce.collected(rows).select("k", F.array_join(F.sort_array("v").cast("array<string>"), ",").alias("v"))


@query("a2_reduce_python", "SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY o_custkey")
def a2(spark, d):
    """An opaque reducer sees all keys of its partition with their values."""

    def reduce(batches):
        for b in batches:
            yield b.assign(v=b["v"].map(max))

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return mapreduce.run(rows, [mapreduce.Phase("reduce_python", reduce, "k long, v double")])


@query("a3_word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n,.;:?!()\"''_-]')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def a3(spark, d):
    rows = table(spark, d, "documents").select(F.explode(mapreduce.words(F.col("text"))).alias("word"))
    return rows.groupBy("word").agg(counted())


@query("a3_word_count_job", "SELECT word AS k, count(*) AS v FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n,.;:?!()\"''_-]')) AS word FROM benchmark) WHERE word <> '' GROUP BY word")
def a3_job(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("v"))
    split = mapreduce.Phase("map", F.transform(mapreduce.words(F.col("v")), lambda w: F.struct(w.alias("k"), F.lit(1).cast("long").alias("v"))))
    return mapreduce.run(rows, [split, mapreduce.Phase("reduce", F.sum("v"))])


@query("a4_counts", "SELECT count(*) AS load, count(*) FILTER (WHERE o_orderkey BETWEEN 100 AND 900) AS inside FROM orders")
def a4(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("load"), F.count_if(F.col("o_orderkey").between(100, 900)).alias("inside"))


@query(
    "a5_load_statistics",
    """SELECT round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END), 2) AS total, round(coalesce(avg(c_acctbal) FILTER (WHERE c_acctbal >= 0), 0), 4) AS average,
    round(coalesce(stddev_pop(c_acctbal) FILTER (WHERE c_acctbal >= 0), 0), 4) AS deviation, coalesce(max(c_acctbal), 0) AS most FROM customer""",
)
def a5(spark, d):
    """Nodes that failed (here: below zero) count nothing in totals and aren't in averages."""
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    zero = F.lit(0.0)
    return table(spark, d, "customer").agg(
        F.round(F.coalesce(F.sum(x), zero), 2).alias("total"), F.round(F.coalesce(F.avg(x), zero), 4).alias("average"), F.round(F.coalesce(F.stddev_pop(x), zero), 4).alias("deviation"), F.coalesce(F.max("c_acctbal"), zero).alias("most")
    )


@query("a6_table_sizes", "SELECT CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 4) AS average, round(stddev_pop(p_size), 4) AS deviation FROM part")
def a6(spark, d):
    return table(spark, d, "part").agg(F.sum("p_size").alias("total"), F.round(F.avg("p_size"), 4).alias("average"), F.round(F.stddev_pop("p_size"), 4).alias("deviation"))


@query(
    "a7_gossip_statistics",
    "SELECT round(avg(l_quantity), 4) AS average, round(sqrt(greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0)), 4) AS deviation, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem",
)
def a7(spark, d):
    x = F.col("l_quantity")
    spread = F.avg(x * x) - F.avg(x) * F.avg(x)
    return table(spark, d, "lineitem").agg(F.round(F.avg(x), 4).alias("average"), F.round(F.sqrt(F.greatest(spread, F.lit(0.0))), 4).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("a7_ring_size", "SELECT round(1000000.0 / avg(gap), 6) AS by_gaps, count(*) AS nodes FROM (SELECT (lead(k, 1, first) OVER (ORDER BY k) - k + 1000000) % 1000000 AS gap FROM (SELECT (s_suppkey * 7919) % 1000000 AS k, min((s_suppkey * 7919) % 1000000) OVER () AS first FROM supplier))")
def a7_size(spark, d):
    """How many nodes a ring of a million keys has, from the mean distance of a node to the next one."""
    nodes = table(spark, d, "supplier").select((F.col("s_suppkey") * 7919 % 1000000).alias("k"))
    rows = running(nodes, ["k"], {}, after={"next": (F.min, F.col("k"))})
    first = nodes.agg(F.min("k").alias("first"))
    gaps = rows.join(F.broadcast(first)).select(F.pmod(F.coalesce("next", "first") - F.col("k"), F.lit(1000000)).alias("gap"))
    return gaps.agg(F.round(1000000.0 / F.avg("gap"), 6).alias("by_gaps"), counted().alias("nodes"))


@query("a8_gossip_histogram", "SELECT CAST(floor(o_orderkey / 2000) + 1 AS BIGINT) AS bucket, round(avg(o_totalprice), 4) AS load FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def a8(spark, d):
    """Buckets of 2,000 keys as far as the keys go."""
    rows = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return rows.groupBy((F.floor(F.col("o_orderkey") / 2000) + 1).alias("bucket")).agg(F.round(F.avg("o_totalprice"), 4).alias("load"))


def _hist(spark, d):
    """The value histogram of quantities: bounded by their few distinct values."""
    return table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(counted())


for _side, _order in (("left", "x"), ("right", "x DESC")):

    @query(f"a16_quantile_from_{_side}", f"WITH h AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT x, sum(n) OVER (ORDER BY {_order}) AS run FROM h) SELECT x AS quantile, CAST(run AS BIGINT) AS reached FROM c WHERE run >= 7000 ORDER BY {_order} LIMIT 1")
    def a16(spark, d, down=_side == "right"):
        x = F.col("x").desc() if down else F.col("x").asc()
        run = _hist(spark, d).withColumn("reached", F.sum("n").over(W.orderBy(x).rowsBetween(W.unboundedPreceding, 0)))
        return run.filter("reached >= 7000").orderBy(x).limit(1).select(F.col("x").alias("quantile"), "reached")


@query("a18_median", "SELECT l_returnflag, median(l_extendedprice) AS middle FROM lineitem GROUP BY l_returnflag")
def a18(spark, d):
    return median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "middle")


@query(
    "a19_weighted_average",
    "SELECT user_id, round(sum(value * rn) / sum(rn), 6) AS average FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id",
)
def a19(spark, d):
    """Linear weights, the newest value heaviest."""
    rows = within(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "rn")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("rn")) / F.sum("rn"), 6).alias("average"))


@query(
    "a20_vector_average",
    "SELECT label, " + ", ".join(f"round(sum(CAST(embedding[{i + 1}] AS DOUBLE) * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 6) AS d{i}" for i in range(4)) + " FROM embeddings GROUP BY label",
)
def a20(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 7 + 1).alias("w"))
    out = rows.groupBy("label").agg(*merge_weighted("v", "w", 4))
    return out.select("label", *(F.round(f"d{i}", 6).alias(f"d{i}") for i in range(4)))


@query(
    "a21_load_change",
    """SELECT l_orderkey, l_linenumber, ((l_quantity - 5) * (l_quantity - 5) - l_quantity * l_quantity + (l_tax * 100 + 5) * (l_tax * 100 + 5) - l_tax * l_tax * 10000) / 2 AS change,
    floor((l_quantity + l_tax * 100) / 2) AS target FROM lineitem""",
)
def a21(spark, d):
    """How moving 5 from one node to another changes the loads' variance, and the load that both would settle at."""
    q, t = F.col("l_quantity"), F.col("l_tax")
    change = ((q - 5) * (q - 5) - q * q + (t * 100 + 5) * (t * 100 + 5) - t * t * 10000) / 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", change.alias("change"), F.floor((q + t * 100) / 2).cast("double").alias("target"))


for _dir, _where, _desc in (("forward", "o_orderkey > 5000", False), ("backward", "o_orderkey <= 5000", True)):

    @query(f"a22_split_key_{_dir}", f"SELECT {'min' if _desc else 'max'}(o_orderkey) AS split_key, count(*) AS load FROM (SELECT o_orderkey FROM orders WHERE {_where} ORDER BY o_orderkey {'DESC' if _desc else ''} LIMIT 1500)")
    def a22(spark, d, where=_where, desc=_desc):
        """The key within which at most so many rows lie from a start on: each task keeps the nearest 1,500 only."""
        rows = table(spark, d, "orders").filter(where).select("o_orderkey")
        far = F.min if desc else F.max
        return rows.orderBy(F.desc("o_orderkey") if desc else "o_orderkey").limit(1500).agg(far("o_orderkey").alias("split_key"), F.count(F.lit(1)).alias("load"))


def _states(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("replica"), "event_id")
    a = e.filter("event_id < 6000").groupBy("name", "replica").agg(counted())
    b = e.filter("event_id < 3000 OR replica = 2").groupBy("name", "replica").agg(counted())
    return a, b


G_A = "SELECT event_type AS name, user_id % 4 AS replica, count(*) AS n FROM events WHERE event_id < 6000 GROUP BY 1, 2"
G_B = "SELECT event_type AS name, user_id % 4 AS replica, count(*) AS n FROM events WHERE event_id < 3000 OR user_id % 4 = 2 GROUP BY 1, 2"


@query("a23_g_counter", f"SELECT name, CAST(sum(n) AS BIGINT) AS value FROM (SELECT name, replica, max(n) AS n FROM ({G_A} UNION ALL {G_B}) GROUP BY 1, 2) GROUP BY name")
def a23(spark, d):
    return crdt.counter_value(crdt.merge_counter(*_states(spark, d)))


@query(
    "a24_pn_counter",
    """SELECT name, CAST(sum(p) - sum(m) AS BIGINT) AS value FROM (SELECT event_type AS name, user_id % 4 AS replica, count(*) FILTER (WHERE event_id % 3 <> 0) AS p,
    count(*) FILTER (WHERE event_id % 3 = 0) AS m FROM events GROUP BY 1, 2) GROUP BY name""",
)
def a24(spark, d):
    """Two counters, one for each direction; the value is their difference."""
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("replica"), "event_id")
    up, down = (e.filter(f).groupBy("name", "replica").agg(counted()) for f in ("event_id % 3 <> 0", "event_id % 3 = 0"))
    p, m = (crdt.counter_value(crdt.merge_counter(s, s.filter("n > 100"))) for s in (up, down))
    return p.join(m.select("name", F.col("value").alias("m")), "name", "left").select("name", (F.col("value") - F.coalesce("m", F.lit(0))).alias("value"))


@query(
    "a25_g_set",
    """SELECT l_suppkey, count(DISTINCT l_partkey) AS elements, bool_or(l_partkey = 77) AS has_77, count(DISTINCT l_partkey) - count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS only_small FROM lineitem GROUP BY l_suppkey""",
)
def a25(spark, d):
    """A set is the distinct (name, element) rows; its size, members and difference are counts over them, whatever a set holds."""
    sets = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_quantity") > 25).alias("big"))
    return sets.groupBy("l_suppkey").agg(counted().alias("elements"), F.bool_or(F.col("l_partkey") == 77).alias("has_77"), F.count_if(~F.col("big")).alias("only_small"))


OR_A = "SELECT DISTINCT user_id AS elem, event_id % 3 AS replica, event_id AS ts FROM events WHERE event_id < 7000 AND event_type <> 'error'"
OR_B = "SELECT DISTINCT user_id AS elem, event_id % 3 AS replica, event_id AS ts FROM events WHERE event_id > 2000 AND event_type <> 'signup'"


@query(
    "a26_or_set",
    f"""WITH a AS ({OR_A}), b AS ({OR_B}), va AS (SELECT replica, max(ts) AS seen FROM a GROUP BY 1), vb AS (SELECT replica, max(ts) - 4000 AS seen FROM b GROUP BY 1)
    SELECT elem, replica, max(ts) AS ts FROM (SELECT * FROM a INTERSECT SELECT * FROM b UNION ALL
    SELECT a.* FROM a LEFT JOIN vb USING (replica) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.elem = a.elem AND b.replica = a.replica AND b.ts = a.ts) AND (vb.seen IS NULL OR a.ts > vb.seen) UNION ALL
    SELECT b.* FROM b LEFT JOIN va USING (replica) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.elem = b.elem AND a.replica = b.replica AND a.ts = b.ts) AND (va.seen IS NULL OR b.ts > va.seen)) GROUP BY 1, 2""",
)
def a26(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("elem"), (F.col("event_id") % 3).alias("replica"), F.col("event_id").alias("ts"), "event_type")
    a, b = e.filter("ts < 7000 AND event_type <> 'error'").drop("event_type").distinct(), e.filter("ts > 2000 AND event_type <> 'signup'").drop("event_type").distinct()
    va, vb = a.groupBy("replica").agg(F.max("ts").alias("seen")), b.groupBy("replica").agg((F.max("ts") - 4000).alias("seen"))
    return crdt.merge_orset(a, b, va, vb)


@query("a27_counter_order", f"SELECT name, bool_and(coalesce(b.n, 0) <= coalesce(a.n, 0)) AS b_below_a, bool_and(coalesce(a.n, 0) <= coalesce(b.n, 0)) AS a_below_b FROM ({G_A}) a FULL JOIN ({G_B}) b USING (name, replica) GROUP BY name")
def a27(spark, d):
    a, b = (crdt.counter_vector(s, 4) for s in _states(spark, d))
    both = a.join(b.withColumnRenamed("v", "w"), "name")
    return both.select("name", crdt.below(F.col("w"), F.col("v")).alias("b_below_a"), crdt.below(F.col("v"), F.col("w")).alias("a_below_b"))


@query("a28_merkle_leaves", "SELECT o_orderkey // 500 AS bucket, sha256(string_agg(o_orderkey || ':' || o_custkey, ',' ORDER BY o_orderkey)) AS hash, count(*) AS n, bit_xor(o_custkey) AS folded FROM orders GROUP BY 1")
def a28(spark, d):
    """A leaf's hash covers its entries in key order; a leaf is a bounded key interval."""
    entry = F.struct("o_orderkey", F.concat_ws(":", "o_orderkey", "o_custkey").alias("e"))
    rows = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).cast("long").alias("bucket"))
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry))["e"], ","), 256).alias("hash"), counted(), F.bit_xor("o_custkey").alias("folded"))


@query("a34_benchmark_statistics", "SELECT event_type, count(*) AS n, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most, round(var_pop(value), 4) AS variance FROM events GROUP BY event_type")
def a34(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(counted(), F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.var_pop("value"), 4).alias("variance"))


@query(
    "a34_throughput",
    """SELECT user_id, count(*) AS iterations, round(epoch_us(max(ts) - min(ts)) / 1e6, 3) AS seconds, round(count(*) * 1e6 / greatest(epoch_us(max(ts) - min(ts)), 1), 9) AS per_second,
    round(epoch_us(max(ts) - min(ts)) / 1e3 / count(*), 3) AS latency_ms, count(*) FILTER (WHERE event_type = 'error') AS aborts FROM events GROUP BY user_id""",
)
def a34_throughput(spark, d):
    """Each client's operations over its time on the clock: throughput, mean latency, aborted ones."""
    us = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(
        n.alias("iterations"), F.round(us / 1e6, 3).alias("seconds"), F.round(n * 1e6 / F.greatest(us, F.lit(1)), 9).alias("per_second"), F.round(us / 1e3 / n, 3).alias("latency_ms"), F.count_if(F.col("event_type") == "error").alias("aborts")
    )


@query("a35_ordered_lists", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a35(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("names"))


@query("a36_site_statistics", "SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM labels WHERE quality = 1) AS good_articles, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS characters")
def a36(spark, d):
    pages = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("characters"))
    good = table(spark, d, "labels").filter("quality = 1").agg(F.count(F.lit(1)).alias("good_articles"))
    return pages.join(good).select("pages", "good_articles", "characters")


@query("a37_compensated_sum", "SELECT o_custkey, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY o_custkey")
def a37(spark, d):
    """Compensated summation of each customer's values, in key order, so that the order of arrival doesn't matter; blocks of 4,096 keys first, then their sums."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def step(acc, x):
        y = x["v"] - acc["lost"]
        t = acc["sum"] + y
        return F.struct(t.alias("sum"), (t - acc["sum"] - y).alias("lost"))

    def summed(rows, *by):
        listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))
        return listed.select(*by, F.aggregate("s", start, step, lambda acc: acc["sum"]).alias("v"))

    rows = table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 4096).alias("block"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("v"))
    blocks = summed(rows, "o_custkey", "block").withColumnRenamed("block", "at")
    return summed(blocks, "o_custkey").select("o_custkey", F.round("v", 4).alias("total"))


@query("a38_ring_size", "SELECT count(*) AS nodes FROM supplier")
def a38(spark, d):
    return table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("nodes"))


@query("a39_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def a39(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("a40_latency_monitor", "SELECT avg_bucket, count(*) AS nodes, round(sum(total) / sum(n), 6) AS mean FROM (SELECT user_id, user_id % 5 AS avg_bucket, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def a40(spark, d):
    """Each node's sums, gathered to a group's mean."""
    nodes = table(spark, d, "events").groupBy("user_id", (F.col("user_id") % 5).alias("avg_bucket")).agg(F.sum("value").alias("total"), counted())
    return nodes.groupBy("avg_bucket").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


@query("m1_keyed_counters", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') - count(*) FILTER (WHERE event_type = 'error') AS value FROM events GROUP BY user_id")
def m1(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") - F.count_if(F.col("event_type") == "error")).alias("value"))


@query(
    "m2_maps",
    """SELECT o_custkey, coalesce(max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), -1.0) AS urgent, count(DISTINCT o_orderpriority) AS keys,
    string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderpriority <> '5-LOW') AS names FROM orders GROUP BY o_custkey""",
)
def m2(spark, d):
    """A map by key: lookup with a default, size, and its keys without one."""
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("m"))
    names = F.array_join(F.sort_array(F.map_keys(F.map_filter("m", lambda k, v: k != "5-LOW"))), ",")
    return maps.select("o_custkey", F.coalesce(F.try_element_at("m", F.lit("1-URGENT")), F.lit(-1.0)).alias("urgent"), F.size("m").cast("long").alias("keys"), F.when(names != "", names).alias("names"))


@query(
    "m2_map_updates",
    """SELECT o_custkey, string_agg(k || '=' || v, ',' ORDER BY k) AS entries, count(*) AS size, CAST(sum(v) AS BIGINT) AS total FROM (SELECT o_custkey, o_orderpriority AS k, count(*) * CASE WHEN o_orderpriority = '2-HIGH' THEN 10 ELSE 1 END AS v FROM orders
    WHERE o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') GROUP BY 1, 2 UNION ALL SELECT DISTINCT o_custkey, '3-MEDIUM', 7 FROM orders) GROUP BY o_custkey""",
)
def m2_updates(spark, d):
    """A map by key: an entry put (over an old one), one removed, one updated where it is; then its entries, size and values."""
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(counted())
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    gone = F.map_filter("m", lambda k, v: ~k.isin("5-LOW", "3-MEDIUM"))
    put = F.map_concat(gone, F.create_map(F.lit("3-MEDIUM"), F.lit(7).cast("long")))
    rows = maps.select("o_custkey", F.transform_values(put, lambda k, v: F.when(k == "2-HIGH", v * 10).otherwise(v)).alias("m"))
    text = F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("o_custkey", text.alias("entries"), F.size("m").cast("long").alias("size"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("m3_latency_median", "SELECT user_id, median(value) AS latency FROM events WHERE event_type = 'view' GROUP BY user_id")
def m3(spark, d):
    return median(table(spark, d, "events").filter("event_type = 'view'"), ["user_id"], "value", "latency")


@query("m4_session_statistics", "SELECT user_id AS session, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS items, count(*) AS rounds FROM events GROUP BY 1")
def m4(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("items"), F.count(F.lit(1)).alias("rounds"))


@query("m5_request_histogram", "SELECT CAST(floor(user_id / 10) + 1 AS BIGINT) AS bucket, round(avg(value), 6) AS requests FROM events GROUP BY 1")
def m5(spark, d):
    """Buckets of ten users as far as the users go."""
    return table(spark, d, "events").groupBy((F.floor(F.col("user_id") / 10) + 1).alias("bucket")).agg(F.round(F.avg("value"), 6).alias("requests"))


@query("m6_node_list", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 12")
def m6(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").orderBy("s_suppkey").limit(12).select("s_suppkey", "s_acctbal")
