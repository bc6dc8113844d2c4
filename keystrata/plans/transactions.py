"""Transaction logs derived from the tables, and their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import transactions as tx
from keystrata.plans.registry import query, table


def ops(spark, d):
    """Each user's events as operations on one key, in order."""
    kind = F.col("event_type")
    e = table(spark, d, "events")
    op = F.when(kind.isin("signup", "purchase"), "write").when(kind == "view", "add_on_nr").otherwise("read")
    return e.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), F.floor("value").cast("double").alias("arg"), F.lit(None).cast("double").alias("expected"))


@query("t1_request_lists", "SELECT user_id, count(*) FILTER (WHERE c) = 0 OR (count(*) FILTER (WHERE c) = 1 AND max(event_id) FILTER (WHERE c) = max(event_id)) AS ok FROM (SELECT *, event_id % 97 = 0 AS c FROM events) GROUP BY user_id")
def t1(spark, d):
    o = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 97 == 0, "commit").otherwise("read").alias("op"))
    return tx.checked(o, "user_id", "event_id", "op")


@query(
    "t1_aborted_results",
    """SELECT e.user_id, event_id, op, CASE WHEN ok THEN 'ok' WHEN op = 'commit' THEN 'fail abort' WHEN op = 'read' THEN 'fail not_found' ELSE 'ok' END AS result FROM
    (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'commit' WHEN event_id % 2 = 0 THEN 'write' ELSE 'read' END AS op FROM events) e JOIN
    (SELECT user_id, count(*) FILTER (WHERE c) = 0 OR (count(*) FILTER (WHERE c) = 1 AND max(event_id) FILTER (WHERE c) = max(event_id)) AS ok FROM (SELECT *, event_id % 97 = 0 AS c FROM events) GROUP BY user_id) USING (user_id)""",
)
def t1_results(spark, d):
    """What each request of an aborted list is answered."""
    k = F.col("event_id")
    o = table(spark, d, "events").select("user_id", "event_id", F.when(k % 97 == 0, "commit").when(k % 2 == 0, "write").otherwise("read").alias("op"))
    return tx.results(o, "user_id", "event_id", "op").select("user_id", "event_id", "op", "result")


@query(
    "t2_read_your_writes",
    """WITH o AS (SELECT user_id, event_id, event_type, floor(value) AS arg FROM events), w AS (SELECT user_id, max(event_id) AS at FROM o WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
    SELECT o.user_id, CASE WHEN count(*) FILTER (WHERE event_type IN ('signup', 'purchase') OR event_type = 'view') = 0 THEN NULL ELSE
    coalesce(sum(arg) FILTER (WHERE event_id = w.at), 0) + coalesce(sum(arg) FILTER (WHERE event_type = 'view' AND event_id > coalesce(w.at, -1)), 0) END AS value, count(*) AS n FROM o LEFT JOIN w USING (user_id) GROUP BY o.user_id""",
)
def t2(spark, d):
    """What a reader at the end of each key's log sees."""
    return tx.replay(ops(spark, d), "user_id", "seq").select("user_id", "value", F.col("n").cast("long").alias("n"))


@query("t4_commit_sanity", "SELECT o_custkey, bool_and(o_orderstatus <> 'F') AS ok, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS failed FROM orders GROUP BY 1")
def t4(spark, d):
    log = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok"))
    return tx.sane(log, "o_custkey", "o_orderkey", "status").select("o_custkey", "ok", F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"))


LOG = "SELECT l_orderkey AS k, l_linenumber AS op, o_custkey + CAST(l_quantity AS BIGINT) % 3 - 1 AS seen, o_custkey AS version, o_orderstatus = 'F' AS locked, l_suppkey % 2 AS readers FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def log(spark, d):
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("version"), (F.col("o_orderstatus") == "F").alias("locked"))
    seen = F.col("version") + F.col("l_quantity").cast("long") % 3 - 1
    return li.join(o, "l_orderkey").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("op"), seen.alias("seen"), "version", "locked", (F.col("l_suppkey") % 2).alias("readers"))


@query("t5_read_validation", f"SELECT k, op, seen, seen >= version AND NOT locked AS valid FROM ({LOG})")
def t5(spark, d):
    return log(spark, d).select("k", "op", "seen", tx.read_valid(F.col("seen"), F.col("version"), F.col("locked")).alias("valid"))


@query("t6_write_validation", f"SELECT k, op, seen, ((seen = version AND readers = 0) OR seen > version) AND NOT locked AS valid FROM ({LOG})")
def t6(spark, d):
    return log(spark, d).select("k", "op", "seen", tx.write_valid(F.col("seen"), F.col("version"), F.col("readers"), F.col("locked")).alias("valid"))


@query(
    "t7_commit",
    """SELECT o_orderkey, CASE WHEN w.v >= o_custkey THEN w.v + 1 ELSE o_custkey END AS version, CASE WHEN w.v >= o_custkey THEN w.x ELSE o_totalprice END AS value FROM orders LEFT JOIN
    (SELECT o_orderkey, o_custkey + o_orderkey % 3 - 1 AS v, o_totalprice * 10 AS x FROM orders WHERE o_orderkey % 2 = 0) w USING (o_orderkey)""",
)
def t7(spark, d):
    o = table(spark, d, "orders")
    store = o.select("o_orderkey", F.col("o_custkey").alias("version"), F.col("o_totalprice").alias("value"))
    writes = o.filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 3 - 1).alias("version"), (F.col("o_totalprice") * 10).alias("value"))
    return tx.commit(store, writes, "o_orderkey", "version", "value")


@query("t11_single_operations", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS aborted FROM events GROUP BY user_id")
def t11(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("aborted"))


@query(
    "t11_each_committed",
    """SELECT user_id, seq, CASE WHEN op = 'read' AND NOT known THEN 'fail not_found' WHEN op = 'add_on_nr' AND NOT number THEN 'fail not_a_number' ELSE 'ok' END AS result FROM
    (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' WHEN event_type = 'view' THEN 'add_on_nr' ELSE 'read' END AS op, c_custkey IS NOT NULL AS known, c_acctbal IS NULL OR c_acctbal >= 0 AS number FROM events LEFT JOIN customer ON c_custkey = user_id)""",
)
def t11_each(spark, d):
    """Requests that each commit on their own, against the store as it was: one that fails takes no other along."""
    store = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("number"), F.lit(True).alias("known"))
    rows = ops(spark, d).join(store, "user_id", "left")
    result = F.when((F.col("op") == "read") & F.col("known").isNull(), "fail not_found").when((F.col("op") == "add_on_nr") & ~F.coalesce("number", F.lit(True)), "fail not_a_number").otherwise("ok")
    return rows.select("user_id", "seq", result.alias("result"))


@query("t12_transfer_invariant", "SELECT count(*) AS accounts, count(*) * 1000 AS total FROM customer")
def t12(spark, d):
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1000).cast("long").alias("balance"))
    moves = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 100 + 1).alias("dst"), F.lit(1).cast("long").alias("amount"))
    known = moves.join(accounts.select(F.col("key").alias("src")), "src", "left_semi").join(accounts.select(F.col("key").alias("dst")), "dst", "left_semi")
    return tx.transfer(accounts, known).agg(F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("total"))
