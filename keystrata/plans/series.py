"""Queries over time slots, changes and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.operators import series as sr
from keystrata.operators import sketch as sk
from keystrata.plans.oracle import HISTOGRAM, bounded_sql, merge_once
from keystrata.plans.registry import query, table

HOUR = "time_bucket(INTERVAL '1 hour', ts)"


def hours(spark, d):
    return table(spark, d, "events").withColumn("slot", sr.slot_of("ts", "1 hour"))


@query("w1_gauge", f"SELECT {HOUR} AS slot, arg_max(value, event_id) AS v FROM events GROUP BY 1")
def w1(spark, d):
    return hours(spark, d).groupBy("slot").agg(sr.gauge("value", "event_id").alias("v"))


@query("w2_counter", f"SELECT {HOUR} AS slot, round(sum(value), 6) AS v FROM events GROUP BY 1")
def w2(spark, d):
    return hours(spark, d).groupBy("slot").agg(F.round(sr.counter("value"), 6).alias("v"))


@query("w3_event", f"SELECT {HOUR} AS slot, string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS entries FROM events GROUP BY 1")
def w3(spark, d):
    rows = hours(spark, d).withColumn("e", F.struct("event_id", "event_type"))
    return rows.groupBy("slot").agg(F.array_join(F.transform(sr.event("ts", "e"), lambda x: F.concat_ws(":", x["e"]["event_id"], x["e"]["event_type"])), ",").alias("entries"))


TIMING = f"SELECT {HOUR} AS slot, round(sum(value), 4) AS sum, round(sum(value * value), 4) AS sum2, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1"


@query("w4_timing", TIMING)
def w4(spark, d):
    out = hours(spark, d).groupBy("slot").agg(*sr.timing("value"))
    return out.withColumns({"sum": F.round("sum", 4), "sum2": F.round("sum2", 4)})


SLOTTED = f"SELECT {HOUR} AS slot, {{}} AS x FROM events"
AS_TEXT = "list_aggregate(list_transform(h, lambda e: CAST(e.x AS VARCHAR) || ':' || e.n), 'string_agg', ',')"


def as_text(h: str):
    """A histogram of whole numbers as x:n, comma-joined."""
    return F.array_join(F.transform(h, lambda e: F.concat_ws(":", e["x"], e["n"])), ",")


@query("w5_timing_histogram", f"SELECT t.*, {AS_TEXT} AS histogram FROM ({TIMING}) t JOIN ({bounded_sql(SLOTTED.format('CAST(floor(value * 10) AS BIGINT)'), 'slot', 20, whole=True)}) USING (slot)")
def w5(spark, d):
    """Timing values with a bounded histogram (of tenths) of each slot."""
    rows = hours(spark, d)
    out = rows.groupBy("slot").agg(*sr.timing("value")).join(sk.bounded(rows, ["slot"], F.floor(F.col("value") * 10), 20, whole=True), "slot")
    return out.select("slot", F.round("sum", 4).alias("sum"), F.round("sum2", 4).alias("sum2"), "n", "least", "most", as_text("h").alias("histogram"))


@query("w6_histogram", f"SELECT slot, round(e.x, 4) AS x, e.n AS n FROM (SELECT slot, unnest(h) AS e FROM ({bounded_sql(SLOTTED.format('value'), 'slot', 10)}))")
def w6(spark, d):
    h = sk.bounded(hours(spark, d), ["slot"], F.col("value"), 10)
    return h.select("slot", F.explode("h").alias("e")).select("slot", F.round("e.x", 4).alias("x"), F.col("e.n").alias("n"))


@query("w6_ring_histogram", f"SELECT slot, (e.x + 30) % 1000 AS key, e.n AS n FROM (SELECT slot, unnest(h) AS e FROM ({bounded_sql(SLOTTED.format('(user_id % 1000 - 30 + 1000) % 1000'), 'slot', 8, whole=True)}))")
def w6_ring(spark, d):
    """Keys of each slot around a ring of a thousand, as distances from key 30 while they are merged."""
    h = sk.bounded(hours(spark, d), ["slot"], F.pmod(F.col("user_id") % 1000 - 30, F.lit(1000)), 8, whole=True)
    return h.select("slot", F.explode("h").alias("e")).select("slot", ((F.col("e.x") + 30) % 1000).alias("key"), F.col("e.n").alias("n"))


@query(
    "w11_advance",
    f"""WITH s AS (SELECT {HOUR} AS slot, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(slot) lo, max(slot) hi FROM s)
    SELECT g.slot, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(lo, hi + INTERVAL '5 hours', INTERVAL '1 hour')) AS slot FROM b) g LEFT JOIN s USING (slot)""",
)
def w11(spark, d):
    """Time moves on five slots without a value: they come into being empty."""
    per = hours(spark, d).groupBy(F.lit(0).alias("g"), "slot").agg(F.count(F.lit(1)).alias("n"))
    now = per.groupBy("g").agg((F.max("slot") + F.expr("INTERVAL 5 HOURS")).alias("slot")).withColumn("n", F.lit(0).cast("long"))
    return sr.fill(per.unionByName(now), ["g"], "slot", ["n"], "1 hour", "zero").drop("g")


@query("w7_slot_origin", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01 00:20:00') AS slot, count(*) AS n FROM events GROUP BY 1")
def w7(spark, d):
    """Slots that begin twenty minutes after the hour."""
    return table(spark, d, "events").groupBy(sr.slot_of("ts", "1 hour", "20 minutes").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "w8_late_dropped",
    """SELECT user_id, count(*) AS kept FROM (SELECT *, max(slot) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS newest FROM
    (SELECT user_id, event_id, event_id + (event_id * 7919) % 400 AS arrival, time_bucket(INTERVAL '1 hour', ts) AS slot FROM events)) WHERE slot = newest GROUP BY user_id""",
)
def w8(spark, d):
    """Rows in a derived order of arrival; a slot before the newest one seen is dropped."""
    e = table(spark, d, "events").withColumn("arrival", F.col("event_id") + (F.col("event_id") * 7919) % 400)
    kept = sr.in_time(e, ["user_id"], sr.slot_of("ts", "1 hour"), ["arrival", "event_id"])
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("w9_retention", f"SELECT event_type, slot, n FROM (SELECT event_type, {HOUR} AS slot, count(*) AS n FROM events GROUP BY 1, 2) s WHERE slot > (SELECT max({HOUR}) FROM events e WHERE e.event_type = s.event_type) - INTERVAL '12 hours'")
def w9(spark, d):
    per = hours(spark, d).groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n"))
    return sr.retained(per, ["event_type"], "slot", 3600, 12)


@query(
    "w10_gap_fill",
    f"""WITH s AS (SELECT event_type, {HOUR} AS slot, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, min(slot) lo, max(slot) hi FROM s GROUP BY 1)
    SELECT g.event_type, g.slot, coalesce(n, 0) AS n FROM (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS slot FROM b) g LEFT JOIN s USING (event_type, slot)""",
)
def w10(spark, d):
    per = hours(spark, d).groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n"))
    return sr.fill(per, ["event_type"], "slot", ["n"], "1 hour", "zero")


@query("w12_dump", f"SELECT {HOUR} AS slot, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 48")
def w12(spark, d):
    """Newest slots first."""
    return hours(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("slot")).limit(48)


@query(
    "w13_merge_newer",
    f"""SELECT slot, sum(n) AS n FROM (SELECT {HOUR} AS slot, count(*) AS n FROM events WHERE event_id < 5000 GROUP BY 1 UNION ALL SELECT slot, n FROM (SELECT {HOUR} AS slot, count(*) AS n FROM events WHERE event_id >= 4000 GROUP BY 1)
    WHERE slot >= (SELECT max({HOUR}) FROM events WHERE event_id < 5000)) GROUP BY slot""",
)
def w13(spark, d):
    """Into a series come the other one's slots from its current one on."""
    old, new = (hours(spark, d).filter(f).groupBy("slot").agg(F.count(F.lit(1)).alias("n")) for f in ("event_id < 5000", "event_id >= 4000"))
    current = old.agg(F.max("slot").alias("current"))
    return sr.merge(old, new.join(F.broadcast(current), F.col("slot") >= F.col("current")).drop("current"), [], "slot", "n", "counter")


@query(
    "w15_change_feed",
    """SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END AS change FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events WHERE event_id BETWEEN 2000 AND 8000) WHERE rn = 1""",
)
def w15(spark, d):
    """Changes of an interval, compacted to the last of each key."""
    e = table(spark, d, "events").filter("event_id BETWEEN 2000 AND 8000")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("event_id"))
    return last.select("user_id", "event_id", F.when(F.col("t") == "error", "deleted").otherwise("changed").alias("change"))


@query("w17_alarms", f"SELECT slot, CASE WHEN v < 35 THEN -1 WHEN v > 65 THEN 1 ELSE 0 END AS step FROM (SELECT {HOUR} AS slot, avg(value) AS v FROM events GROUP BY 1)")
def w17(spark, d):
    v = F.avg("value")
    return hours(spark, d).groupBy("slot").agg(F.when(v < 35, -1).when(v > 65, 1).otherwise(0).alias("step"))


@query(
    "a10_merge_series",
    f"SELECT slot, arg_min(v, p) AS v FROM (SELECT {HOUR} AS slot, arg_max(value, event_id) AS v, 0 AS p FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT {HOUR}, arg_max(value, event_id), 1 FROM events WHERE event_type <> 'view' GROUP BY 1) GROUP BY slot",
)
def a10(spark, d):
    first, second = (hours(spark, d).filter(f).groupBy("slot").agg(sr.gauge("value", "event_id").alias("v")) for f in ("event_type = 'view'", "event_type <> 'view'"))
    return sr.merge(first, second, [], "slot", "v", "gauge")


HALVES = "(SELECT *, event_type = 'view' AS own FROM events WHERE event_id % 5 <> 0 OR event_type = 'view')"


@query(
    "a10_merge_kinds",
    f"""SELECT slot, round(sum(value), 4) AS counter, string_agg(event_id, ',' ORDER BY ts, event_id) AS event, round(sum(value * value), 4) AS sum2, count(*) AS n, min(value) AS least, max(value) AS most
    FROM (SELECT *, {HOUR} AS slot FROM {HALVES}) GROUP BY slot""",
)
def a10_kinds(spark, d):
    """Two series merged kind by kind: counters and timings from both, events as one list without repeats."""
    rows = hours(spark, d).filter("event_id % 5 <> 0 OR event_type = 'view'")
    own, other = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")
    each = lambda x: x.groupBy("slot").agg(sr.event("ts", "event_id").alias("event"), *sr.timing("value"))
    both = each(own).unionByName(each(other)).groupBy("slot").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("event")))).alias("event"), *sr.combine_timing())
    return both.select("slot", F.round("sum", 4).alias("counter"), F.array_join(F.transform("event", lambda e: e["event_id"].cast("string")), ",").alias("event"), F.round("sum2", 4).alias("sum2"), "n", "least", "most")


@query(
    "a10_merge_histograms",
    f"""WITH h AS ({bounded_sql(f"SELECT {HOUR} AS slot, own, CAST(floor(value * 10) AS BIGINT) AS x FROM {HALVES}", 'slot, own', 6, whole=True)})
    SELECT slot, {AS_TEXT} AS histogram FROM (SELECT slot, list_reduce(list(h ORDER BY own DESC), lambda a, h: list_reduce(list_concat([list_sort(list_concat(a, h))], list_transform(range(6), lambda _: CAST([] AS {HISTOGRAM.format('BIGINT')}))),
    lambda b, _: {merge_once('b', 6, True)})) AS h FROM h GROUP BY slot)""",
)
def a10_histograms(spark, d):
    """The second series' histograms added to the first one's, slot by slot."""
    rows = hours(spark, d).filter("event_id % 5 <> 0 OR event_type = 'view'").withColumn("own", (F.col("event_type") != "view").cast("int"))
    h = sk.bounded(rows, ["slot", "own"], F.floor(F.col("value") * 10), 6, whole=True)
    both = h.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("own", "h"))).alias("p"))
    return both.select("slot", F.expr(sk.merged("transform(p, q -> q.h)", 6, True)).alias("h")).select("slot", as_text("h").alias("histogram"))


@query("a11_combine_slots", "SELECT time_bucket(INTERVAL '1 day', ts) AS slot, round(sum(value), 4) AS sum, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def a11(spark, d):
    """Days from the hours' partials, not from the rows."""
    per = hours(spark, d).groupBy("slot").agg(*sr.timing("value"))
    out = per.groupBy(F.window("slot", "1 day")["start"].alias("day")).agg(*sr.combine_timing())
    return out.select(F.col("day").alias("slot"), F.round("sum", 4).alias("sum"), "n", "least", "most")


@query(
    "a12_slot_statistics",
    f"""WITH s AS (SELECT {HOUR} AS slot, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS dev FROM events GROUP BY 1), b AS (SELECT min(slot) lo, max(slot) hi FROM s)
    SELECT g.slot, coalesce(n, 0) AS n, round(coalesce(n, 0) / 3600.0, 6) AS per_second, round(coalesce(mean, 0), 4) AS mean, round(coalesce(dev, 0), 4) AS deviation FROM (SELECT unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS slot FROM b) g LEFT JOIN s USING (slot)""",
)
def a12(spark, d):
    per = hours(spark, d).groupBy(F.lit(0).alias("g"), "slot").agg(*sr.timing("value"))
    all_ = sr.fill(per, ["g"], "slot", ["sum", "sum2", "n"], "1 hour")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    n = F.coalesce("n", F.lit(0))
    return all_.select("slot", n.alias("n"), F.round(n / 3600.0, 6).alias("per_second"), zero(F.col("sum") / F.col("n")).alias("mean"), zero(sr.deviation()).alias("deviation"))


@query("a13_scaled_gauge", f"SELECT {HOUR} AS slot, arg_max(value, event_id) / 1000 AS v FROM events GROUP BY 1")
def a13(spark, d):
    return hours(spark, d).groupBy("slot").agg((sr.gauge("value", "event_id") / 1000).alias("v"))


TENTHS = f"SELECT event_type, {HOUR} AS slot, CAST(floor(value * 10) AS BIGINT) AS x FROM events"


@query(
    "a9_slot_types",
    f"""SELECT s.*, {AS_TEXT} AS histogram FROM (SELECT event_type, {HOUR} AS slot, arg_max(value, event_id) AS gauge, round(sum(value), 4) AS counter, string_agg(event_id, ',' ORDER BY ts, event_id) AS event,
    round(sum(value * value), 4) AS sum2, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2) s JOIN ({bounded_sql(TENTHS, 'event_type, slot', 5, whole=True)}) USING (event_type, slot)""",
)
def a9(spark, d):
    """Every kind of slot value at once: gauge, counter, events, timing, and a bounded histogram."""
    rows = hours(spark, d)
    timing = {c.strip(): F.col(c) for c in ("n", "least", "most")}
    out = rows.groupBy("event_type", "slot").agg(sr.gauge("value", "event_id").alias("gauge"), F.array_join(F.transform(sr.event("ts", "event_id"), lambda e: e["event_id"].cast("string")), ",").alias("event"), *sr.timing("value"))
    out = out.join(sk.bounded(rows, ["event_type", "slot"], F.floor(F.col("value") * 10), 5, whole=True), ["event_type", "slot"])
    return out.select("event_type", "slot", "gauge", F.round("sum", 4).alias("counter"), "event", F.round("sum2", 4).alias("sum2"), *timing, as_text("h").alias("histogram"))


@query("w14_report_closed", f"SELECT slot, n FROM (SELECT {HOUR} AS slot, count(*) AS n FROM events GROUP BY 1) WHERE slot < (SELECT max({HOUR}) FROM events)")
def w14(spark, d):
    """A slot is reported when a later one has begun."""
    per = hours(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    newest = table(spark, d, "events").agg(F.max(F.col("ts")).alias("t")).select(sr.slot_of("t", "1 hour").alias("newest"))
    return per.join(F.broadcast(newest), F.col("slot") < F.col("newest")).select("slot", "n")
