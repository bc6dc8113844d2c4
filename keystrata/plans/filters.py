"""Partial reads, pushed-down predicates and projections, JSON paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import lists as ls
from keystrata.plans.oracle import bloom_sql, hex_part
from keystrata.plans.registry import query, table

LINES = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey"


def order_parts(spark, d):
    """Each order's parts in line order."""
    got = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return got.select("l_orderkey", F.col("s.l_partkey").alias("parts"))


def _flat(col):
    """Lists as text, so that every engine compares them alike."""
    return F.array_join(col.cast("array<string>"), ",")


for _name, _start, _len, _slice in (
    ("from_front", 2, 2, "parts[2:3]"),
    ("from_end", -2, 5, "CASE WHEN len(parts) >= 2 THEN parts[len(parts)-1:] ELSE parts END"),
    ("backwards", 3, -2, "list_reverse(CASE WHEN len(parts) >= 3 THEN parts[2:3] ELSE parts[greatest(len(parts)-1, 1):] END)"),
    ("last_backwards", -1, -3, "list_reverse(parts[greatest(len(parts)-2, 1):])"),
):

    @query(f"f1_sublist_{_name}", f"SELECT l_orderkey, array_to_string({_slice}, ',') AS part, len(parts) AS n FROM ({LINES})")
    def f1(spark, d, start=_start, length=_len):
        rows = order_parts(spark, d)
        return rows.select("l_orderkey", _flat(ls.sublist(F.col("parts"), F.lit(start), F.lit(length))).alias("part"), F.size("parts").cast("long").alias("n"))


@query("f2_random_element", f"SELECT l_orderkey, parts[{hex_part('l_orderkey', 0)} % len(parts) + 1] AS element, len(parts) AS n FROM ({LINES})")
def f2(spark, d):
    """An element of each list, drawn by its key's hash so that a query can be repeated, and the list's length."""
    from keystrata.operators.sketch import hashes

    rows = order_parts(spark, d)
    n = F.size("parts").cast("long")
    return rows.select("l_orderkey", F.when(n > 0, F.get("parts", (hashes(F.col("l_orderkey"), 1, "md5")[0] % n).cast("int"))).alias("element"), n.alias("n"))


@query("f3_filter_and_value", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 5")
def f3(spark, d):
    rows = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 5))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("f4_tagged_input", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def f4(spark, d):
    return table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("f5_read_filters", "SELECT o_orderkey, o_totalprice AS value, o_custkey AS version FROM orders")
def f5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("version"))


@query(
    "f6_content_checks",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'writelock_set' END, CASE WHEN o_totalprice > 300000 THEN 'readlock_set' END,
    CASE WHEN o_custkey % 10 = 0 THEN 'version_mismatch' END) AS reasons, NOT (o_orderstatus = 'F' OR o_totalprice > 300000 OR o_custkey % 10 = 0) AS passes FROM orders""",
)
def f6(spark, d):
    """All reasons that speak against a write, not just the first."""
    tests = {"writelock_set": F.col("o_orderstatus") == "F", "readlock_set": F.col("o_totalprice") > 300000, "version_mismatch": F.col("o_custkey") % 10 == 0}
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in tests.items())))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passes"))


@query("f7_interval_membership", "SELECT o_orderkey, (o_orderkey > 100 AND o_orderkey <= 500) OR (o_orderkey >= 9000) OR o_orderkey = 7 AS inside FROM orders")
def f7(spark, d):
    from keystrata.operators.intervals import ALL, Interval, member

    pieces = [Interval(100, 500, False, True), Interval(9000, ALL, True, True), Interval(7, 7, True, True)]
    return table(spark, d, "orders").select("o_orderkey", member(F.col("o_orderkey"), pieces).alias("inside"))


@query("f8_object_filter", "SELECT p_partkey, p_name FROM part WHERE p_retailprice < 1200.5 AND p_size >= 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def f8(spark, d):
    from keystrata.operators.objects import ObjectQuery

    busy = table(spark, d, "lineitem").filter("l_quantity > 48").select("l_partkey")
    rows = ObjectQuery(table(spark, d, "part")).where((F.col("p_retailprice") < 1200.5) & (F.col("p_size") >= 10)).not_in("p_partkey", busy, "l_partkey")
    return rows.result("p_partkey", "p_name")


@query("f8_failed_evaluation", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 3 AND json_extract_string(props, '$.none') IS NULL")
def f8_failed(spark, d):
    """What can't be evaluated is false, and so is what compares with a variable that isn't there."""
    from keystrata.operators.objects import ObjectQuery

    rows = ObjectQuery(table(spark, d, "events"))
    number, absent = F.get_json_object("props", "$.k").try_cast("long"), F.get_json_object("props", "$.none")
    either = rows.where((number > 3) | (F.col("event_type").try_cast("long") > 0) | (absent == "x"))
    return either.result("event_id")


@query("f9_result_aliases", "SELECT s_name AS supplier, round(s_acctbal, 1) AS balance FROM supplier")
def f9(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("supplier"), F.round("s_acctbal", 1).alias("balance"))


@query("f10_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO%' OR p_name LIKE 'a%'")
def f10(spark, d):
    p = F.col("p_type")
    return table(spark, d, "part").filter(p.startswith("STANDARD") | p.startswith("PROMO") | F.col("p_name").startswith("a")).select("p_partkey", "p_type")


@query("f11_json_fetch", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS other FROM events")
def f11(spark, d):
    from keystrata.functions.json_path import fetch

    return table(spark, d, "events").select("event_id", fetch("props", ["k"]).cast("long").alias("k"), fetch("props", ["none"], "absent").alias("other"))


@query("f12_json_test", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) = 3, false) AS equal FROM events")
def f12(spark, d):
    from keystrata.functions.json_path import test

    return table(spark, d, "events").select("event_id", test("props", ["k"], 3).alias("equal"))


@query(
    "f13_entry_predicates",
    "SELECT o_orderkey, o_orderstatus = 'F' OR o_custkey % 4 > 0 AS locked, o_totalprice IS NULL OR o_totalprice < 1000 AS empty, CAST(o_custkey % 4 AS BIGINT) AS read_locks FROM orders",
)
def f13(spark, d):
    reads = F.col("o_custkey") % 4
    return table(spark, d, "orders").select(
        "o_orderkey", ((F.col("o_orderstatus") == "F") | (reads > 0)).alias("locked"), (F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 1000)).alias("empty"), reads.cast("long").alias("read_locks")
    )


@query(
    "f14_bloom_filter",
    f"""SELECT big.o_orderkey IS NOT NULL AS member, hit, count(*) AS n FROM lineitem JOIN ({bloom_sql('SELECT o_orderkey AS x FROM orders WHERE o_totalprice > 250000', 'SELECT DISTINCT l_orderkey AS x FROM lineitem', 0.01)}) ON x = l_orderkey
    LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000) big ON big.o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def f14(spark, d):
    """A Bloom filter over big orders, applied to lines: positively it drops no line of theirs, negatively what it leaves is none."""
    from keystrata.operators.sketch import bloom_of

    big = table(spark, d, "orders").filter("o_totalprice > 250000").select("o_orderkey")
    marked = bloom_of(big, "o_orderkey", big.count(), 0.01, "md5").mark(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", "hit")
    member = marked.join(big.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("m")), "l_orderkey", "left")
    return member.groupBy(F.coalesce("m", F.lit(False)).alias("member"), "hit").agg(F.count(F.lit(1)).alias("n"))
