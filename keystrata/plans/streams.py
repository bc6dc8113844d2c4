"""Stream forms of slot queries, run over the events as files that arrive one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators.series import timing
from keystrata.plans.registry import query, table
from keystrata.plans.series import HOUR, TIMING
from keystrata.streaming import slots as sl


@query("w4_timing_stream", TIMING)
def w4_stream(spark, d):
    out = sl.finished(sl.timing(sl.replayed(table(spark, d, "events"), "event_id"), "ts", "value", "1 hour", timing), "complete")
    return out.withColumns({"sum": F.round("sum", 4), "sum2": F.round("sum2", 4)}).drop("_batch")


@query(
    "w8_late_stream",
    f"""SELECT user_id, count(*) AS kept FROM (SELECT *, max(slot) OVER (PARTITION BY user_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS newest FROM
    (SELECT user_id, event_id * 1000 + (event_id * 7919) % 400000 AS arrival, {HOUR} AS slot FROM events)) WHERE slot = newest GROUP BY user_id""",
)
def w8_stream(spark, d):
    """The same rows stay whether they arrive in one table or file by file."""
    e = table(spark, d, "events").select("user_id", "ts", (F.col("event_id") * 1000 + (F.col("event_id") * 7919) % 400000).alias("arrival"))
    kept = sl.finished(sl.drop_late(sl.replayed(e, "arrival"), "user_id", "ts", "arrival", 3600), "append")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("w15_change_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w15_stream(spark, d):
    feed = sl.change_feed(sl.replayed(table(spark, d, "events").select("user_id", "event_id", "event_type"), "event_id"), "user_id", "event_id", ["event_type"])
    return sl.finished(feed, "complete").drop("_batch")


@query("w17_alarm_stream", f"SELECT slot, CASE WHEN v < 35 THEN -1 WHEN v > 65 THEN 1 ELSE 0 END AS step FROM (SELECT {HOUR} AS slot, avg(value) AS v FROM events GROUP BY 1)")
def w17_stream(spark, d):
    return sl.finished(sl.alarms(sl.replayed(table(spark, d, "events"), "event_id"), "ts", "value", "1 hour", 35, 65), "complete").drop("_batch")
