"""Scalar functions: numbers, compare and set, vectors, time, lists, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions import keys as ky
from keystrata.functions import vectors as vc
from keystrata.operators import lists as ls
from keystrata.operators.ranks import of_key, running
from keystrata.plans.filters import _flat, order_parts
from keystrata.plans.oracle import hex_part
from keystrata.plans.registry import query, table

LINES = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey"


def parts(spark, d):
    return order_parts(spark, d).withColumnRenamed("parts", "p")


@query("c1_add_on_number", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END + 10 AS value, c_custkey % 5 = 0 AS created FROM customer")
def c1(spark, d):
    """A key without a number begins at 0."""
    held = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", (F.coalesce(held, F.lit(0.0)) + 10).alias("value"), held.isNull().alias("created"))


@query("c2_increment", "SELECT event_id, CASE WHEN event_type = 'error' THEN 5 ELSE CAST(json_extract(props, '$.k') AS BIGINT) + 5 END AS value FROM events")
def c2(spark, d):
    """What isn't a whole number is replaced by the increment."""
    k = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("long"))
    return table(spark, d, "events").select("event_id", F.coalesce(k + 5, F.lit(5).cast("long")).alias("value"))


@query("c3_test_and_set", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'done' ELSE o_orderstatus END AS value, CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'key_changed' END AS status FROM orders")
def c3(spark, d):
    same = F.col("o_orderstatus").eqNullSafe("O")
    return table(spark, d, "orders").select("o_orderkey", F.when(same, "done").otherwise(F.col("o_orderstatus")).alias("value"), F.when(same, "ok").otherwise("key_changed").alias("status"))


@query(
    "c4_numeric",
    "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 3), 4) AS cube, round(ln(l_quantity) / ln(3), 6) AS log3, round(log2(l_quantity), 6) AS lg, round(ln(1 + l_tax), 6) AS l1p, floor(l_extendedprice / 7) AS down, ceil(l_extendedprice / 7) AS up FROM lineitem",
)
def c4(spark, d):
    q, e = F.col("l_quantity"), F.col("l_extendedprice") / 7
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.pow(q, F.lit(3)), 4).alias("cube"), F.round(F.log(3.0, q), 6).alias("log3"), F.round(F.log2(q), 6).alias("lg"), F.round(F.log1p("l_tax"), 6).alias("l1p"), F.floor(e).cast("double").alias("down"), F.ceil(e).cast("double").alias("up"))


@query("c5_number_theory", "SELECT p_partkey, p_size, gcd(p_partkey, p_size) AS divisor, CAST(factorial(p_size % 15) AS BIGINT) AS f, CAST(factorial(p_size % 15) / (factorial(p_size % 15 - least(p_size % 15, 4)) * factorial(least(p_size % 15, 4))) AS BIGINT) AS choose FROM part")
def c5(spark, d):
    n = F.col("p_size") % 15
    return table(spark, d, "part").select("p_partkey", "p_size", vc.gcd(F.col("p_partkey"), F.col("p_size")).alias("divisor"), F.factorial(n).alias("f"), vc.binomial(n, F.least(n, F.lit(4))).cast("long").alias("choose"))


@query(
    "c6_vectors",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, round(list_distance(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3)), 5) AS moved FROM embeddings""",
)
def c6(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(vc.norm(v), 5).alias("norm"), F.round(vc.distance(v, vc.scale(v, 3.0)), 5).alias("moved"))


BIG = "SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000000000000 + o_custkey * 1000000 + 999999 AS n, CAST(o_custkey AS HUGEINT) * 1000000000 + o_orderkey AS m FROM orders"


def big(spark, d):
    """Two numbers of each order by their digits of base 10^6."""
    from keystrata.functions import positional as ps

    k, c = (F.col(x).cast("decimal(38,0)") for x in ("o_orderkey", "o_custkey"))
    n = k * F.lit(10**12).cast("decimal(13,0)") + c * F.lit(10**6).cast("decimal(7,0)") + F.lit(999999)
    m = c * F.lit(10**9).cast("decimal(10,0)") + k
    return table(spark, d, "orders").select("o_orderkey", ps.digits_of(n, 10**6, 4).alias("n"), ps.digits_of(m, 10**6, 4).alias("m"))


@query("c7_positional_numbers", f"SELECT o_orderkey, CAST(n * n AS VARCHAR) AS square FROM ({BIG})")
def c7(spark, d):
    """Products of numbers given by digits of base 10^6."""
    from keystrata.functions import positional as ps

    return big(spark, d).select("o_orderkey", ps.decimal_text(ps.times(F.col("n"), F.col("n"), 10**6), 6).alias("square"))


@query("c7_positional_arithmetic", f"SELECT o_orderkey, CAST(n + m AS VARCHAR) AS plus, CAST(greatest(n, m) - least(n, m) AS VARCHAR) AS minus, CAST(n // 7919 AS VARCHAR) AS divided, CAST((m - n + CAST(1000000000000 AS HUGEINT) * 1000000000000) % (CAST(1000000000000 AS HUGEINT) * 1000000000000) AS VARCHAR) AS wrapped FROM ({BIG})")
def c7_arithmetic(spark, d):
    """Sum, difference, quotient, and a difference that wraps around at four digits."""
    from keystrata.functions import positional as ps

    n, m, base = F.col("n"), F.col("m"), 10**6
    text = lambda x, name: ps.decimal_text(x, 6).alias(name)
    return big(spark, d).select("o_orderkey", text(ps.plus(n, m, base), "plus"), text(ps.minus(F.greatest(n, m), F.least(n, m), base), "minus"), text(ps.divided(n, 7919, base), "divided"), text(ps.minus(m, n, base), "wrapped"))


@query(
    "c8_primes",
    """WITH t AS (SELECT unnest(range(2, (SELECT CAST(sqrt(max(o_orderkey)) AS BIGINT) + 2 FROM orders))) AS i)
    SELECT o_orderkey, o_orderkey > 1 AND NOT EXISTS (SELECT 1 FROM t WHERE i * i <= o_orderkey AND o_orderkey % i = 0) AS prime FROM orders""",
)
def c8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ky.is_prime(F.col("o_orderkey")).alias("prime"))


@query("c9_time", "SELECT event_id, epoch_us(ts) AS us, strftime(ts + INTERVAL '90 seconds', '%Y-%m-%d %H:%M:%S') AS later, epoch_us(ts + INTERVAL '1500 milliseconds') AS us_later FROM events")
def c9(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_micros(ts).alias("us"), F.date_format(ts + F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd HH:mm:ss").alias("later"), F.unix_micros(ts + F.expr("INTERVAL 1500 MILLISECONDS")).alias("us_later"))


@query("c10_strings", "SELECT doc_id, replace(source, 's', '\\s') AS escaped, lower(lang) AS lang, len(list_filter(regexp_split_to_array(source, '[0-9]'), lambda x: x <> '')) AS tokens FROM documents")
def c10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace("source", F.lit("s"), F.lit("\\s")).alias("escaped"), F.lower("lang").alias("lang"), F.size(F.filter(F.split("source", "[0-9]"), lambda x: x != "")).cast("long").alias("tokens"))


@query("c11_key_hash", "SELECT c_custkey, md5(c_name) AS hash FROM customer")
def c11(spark, d):
    return table(spark, d, "customer").select("c_custkey", ky.hashed("c_name").alias("hash"))


@query("c12_replica_keys", "SELECT c_custkey, r, substr('0123456789abcdef', CAST((strpos('0123456789abcdef', md5(c_name)[1]) - 1 + r * 4) % 16 + 1 AS INT), 1) || substr(md5(c_name), 2) AS key, (strpos('0123456789abcdef', md5(c_name)[1]) - 1) // 4 + 1 AS segment FROM customer, (VALUES (0), (1), (2), (3)) t(r)")
def c12(spark, d):
    rows = table(spark, d, "customer").withColumn("h", ky.hashed("c_name"))
    return rows.select("c_custkey", F.posexplode(ky.replicas(F.col("h"), 4)).alias("r", "key"), ky.segment(F.col("h"), 4).cast("long").alias("segment"))


HALF = "CAST(CAST('0x' || substr({}, {}, 16) AS UBIGINT) AS HUGEINT)"
AROUND = "CAST(18446744073709551616 AS HUGEINT)"


@query(
    "c12_ring_distance",
    f"""SELECT c_custkey, printf('%016x', CAST((bh - ah - (bl < al)::INT + {AROUND}) % {AROUND} AS UBIGINT)) || printf('%016x', CAST((bl - al + {AROUND}) % {AROUND} AS UBIGINT)) AS distance FROM
    (SELECT c_custkey, {HALF.format("a", 1)} AS ah, {HALF.format("a", 17)} AS al, {HALF.format("b", 1)} AS bh, {HALF.format("b", 17)} AS bl FROM (SELECT c_custkey, md5(c_name) AS a, md5(c_mktsegment || c_custkey) AS b FROM customer))""",
)
def c12_distance(spark, d):
    """From one key's place on to another's, around the ring."""
    a, b = ky.hashed("c_name"), F.md5(F.concat(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).cast("binary"))
    return table(spark, d, "customer").select("c_custkey", ky.ring_distance(a, b).alias("distance"))


@query(
    "c13_list_helpers",
    f"SELECT l_orderkey, array_to_string(p[1:2], ',') AS taken, list_position(p, p[len(p)]) AS at, array_to_string(list_transform(p, lambda x, i: x * i), ',') AS weighted, len(p[1:len(p) // 3 + CASE WHEN len(p) % 3 > 0 THEN 1 ELSE 0 END]) AS first_block FROM ({LINES})",
)
def c13(spark, d):
    p = F.col("p")
    return parts(spark, d).select(
        "l_orderkey", _flat(F.slice(p, 1, 2)).alias("taken"), ls.index_of(p, F.element_at(p, -1)).cast("long").alias("at"), _flat(F.transform(p, lambda x, i: x * (i + 1))).alias("weighted"), F.size(ls.blocks(p, 3)[0]).cast("long").alias("first_block")
    )


@query(
    "c13_list_parts",
    f"""SELECT l_orderkey, list_filter(p, lambda x: x % 3 = 0)[1] AS taken, array_to_string(list_filter(p, lambda x: x < p[1]), ',') AS below, array_to_string(list_filter(p, lambda x: x = p[1]), ',') AS at, array_to_string(list_filter(p, lambda x: x > p[1]), ',') AS above,
    array_to_string(CASE WHEN list_position(p, 5) IS NULL THEN list_concat(p, [5]) ELSE p END, ',') AS keys FROM ({LINES})""",
)
def c13_parts(spark, d):
    """The first element that passes a test; elements below, at and above the first; a pair stored by its key."""
    p = F.col("p")
    three = ls.partition3(p, lambda x: x - F.get(p, F.lit(0)))
    stored = ls.key_store(F.transform(p, lambda x: F.struct(x.alias("k"), F.lit(0).alias("v"))), F.lit(5).cast("long"), F.lit(1))
    keys = F.transform(stored, lambda x: x["k"])
    return parts(spark, d).select("l_orderkey", ls.take_with(p, lambda x: x % 3 == 0)["taken"].alias("taken"), *(_flat(three[n]).alias(n) for n in ("below", "at", "above")), _flat(keys).alias("keys"))


@query("c14_binary", "SELECT o_orderkey, xor(o_orderkey, o_custkey) AS x, o_orderkey & o_custkey AS a, o_orderkey | o_custkey AS o FROM orders")
def c14(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", k.bitwiseXOR(c).alias("x"), k.bitwiseAND(c).alias("a"), k.bitwiseOR(c).alias("o"))


@query("c15_hash_functions", f"SELECT c_custkey, string_agg(({hex_part('c_name', 0)} % 65536 + i * ({hex_part('c_name', 1)} % 65535 + 1)) % 65536, ',' ORDER BY i) AS places FROM customer, (SELECT unnest(range(4)) AS i) GROUP BY c_custkey")
def c15(spark, d):
    """Four hash functions of a name by double hashing."""
    from keystrata.operators.sketch import positions

    return table(spark, d, "customer").select("c_custkey", _flat(positions(F.col("c_name"), 1 << 16, 4, "md5")).alias("places"))


#: Fixed value: the polynomial of the checksum, its bits reversed.
CRC_BITS = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


@query("c16_checksum", f"SELECT c_custkey, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c_name, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {CRC_BITS}), 4294967295) AS checksum FROM customer")
def c16(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("checksum"))


@query("c18_array_edits", f"SELECT l_orderkey, array_to_string(list_concat(p[1:1], [-1], p[2:]), ',') AS inserted, array_to_string(list_concat(p, [-2]), ',') AS appended, array_to_string(p[1:len(p) - 1], ',') AS popped FROM ({LINES})")
def c18(spark, d):
    p = F.col("p")
    return parts(spark, d).select(
        "l_orderkey", _flat(F.concat(F.slice(p, 1, 1), F.array(F.lit(-1).cast("long")), F.slice(p, F.lit(2), F.size(p)))).alias("inserted"), _flat(F.array_append(p, F.lit(-2).cast("long"))).alias("appended"), _flat(F.slice(p, F.lit(1), F.size(p) - 1)).alias("popped")
    )


@query("c17_json_patch", "SELECT event_id, '{\"list\":[2,3],\"old\":' || json_extract(props, '$.k') || '}' AS props, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM events")
def c17(spark, d):
    """A patch of several steps on each document, all or nothing."""
    from keystrata.functions.json_path import patch

    steps = [{"op": "add", "path": ["list"], "value": [1, 2]}, {"op": "add", "path": ["list", "-"], "value": 3}, {"op": "move", "from": ["k"], "path": ["old"]}, {"op": "remove", "path": ["list", 0]}]
    return patch(table(spark, d, "events").select("event_id", "props"), "props", steps)


@query(
    "c20_coordinate_update",
    """SELECT vec_id, round(CASE WHEN away = 0 THEN x ELSE x + (x - 0.1) * (latency - away) * 0.5 * w / away END, 6) AS x, round(CASE WHEN away = 0 THEN e ELSE abs(away - latency) / latency * 0.5 * w + e * (1 - 0.5 * w) END, 6) AS error FROM
    (SELECT *, CASE WHEN e + 0.5 = 0 THEN 0 ELSE e / (e + 0.5) END AS w FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, vec_id % 7 + 1.0 AS latency, (vec_id % 5) / 10.0 AS e,
    sqrt(list_sum(list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 0.1) * (CAST(v AS DOUBLE) - 0.1)))) AS away FROM embeddings))""",
)
def c20(spark, d):
    """A coordinate and its error after the latency to another point was measured."""
    own = F.col("embedding").cast("array<double>")
    moved, error = vc.vivaldi(F.transform(own, lambda x: F.lit(0.1)), F.lit(0.5), (F.col("vec_id") % 7 + 1).cast("double"), own, (F.col("vec_id") % 5) / 10.0)
    return table(spark, d, "embeddings").select("vec_id", F.round(moved[0], 6).alias("x"), F.round(error, 6).alias("error"))


@query("c21_key_deltas", "SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders")
def c21(spark, d):
    rows = running(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], {"b": (F.max, F.struct("o_custkey", "o_orderkey"))}, inclusive=False)
    return rows.select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.coalesce(of_key("b", "o_custkey", "o_orderkey"), F.lit(0))).alias("delta"))


@query("c22_failure_rates", "SELECT p_size, CAST(ceil(-(p_size * 1000) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, round(pow(1 - exp(-7.0 * p_size / 400), 7), 6) AS rate FROM (SELECT DISTINCT p_size FROM part)")
def c22(spark, d):
    """Bits of a filter for a failure rate, and the rate of a filter of 400 bits."""
    n = F.col("p_size")
    ln2 = F.log(F.lit(2.0))
    bits = F.ceil(-(n * 1000) * F.log(F.lit(0.01)) / (ln2 * ln2))
    return table(spark, d, "part").select("p_size").distinct().select("p_size", bits.alias("bits"), F.round(F.pow(1 - F.exp(F.lit(-7.0) * n / 400), F.lit(7)), 6).alias("rate"))


@query("c23_bucket_suffix", f"SELECT doc_id, {hex_part('doc_id', 0)} % 8 AS bucket FROM documents")
def c23(spark, d):
    from keystrata.operators.sketch import hashes

    return table(spark, d, "documents").select("doc_id", (hashes(F.col("doc_id"), 1, "md5")[0] % 8).alias("bucket"))


@query("c24_page_titles", "SELECT n_nationkey, 'N' || n_regionkey || ':' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS title FROM nation")
def c24(spark, d):
    name = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws(":", F.concat(F.lit("N"), F.col("n_regionkey").cast("string")), name).alias("title"))


@query("c25_clamp", "SELECT s_suppkey, least(greatest(s_acctbal, 0), 5000) AS balance FROM supplier")
def c25(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", vc.clamp(F.col("s_acctbal"), 0.0, 5000.0).alias("balance"))


@query(
    "c21_packed_deltas",
    """SELECT o_custkey, max(w) AS width, string_agg(lpad(bin(delta), CAST(w AS INT), '0'), '' ORDER BY o_orderkey) AS bits, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM
    (SELECT *, max(len(bin(delta))) OVER (PARTITION BY o_custkey) AS w FROM (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders)) GROUP BY o_custkey""",
)
def c21_packed(spark, d):
    """Sorted keys as differences of a fixed number of bits, and the keys that come out of the bits again."""
    keys = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    width, bits = vc.packed(F.col("k"))
    rows = keys.select("o_custkey", width.cast("long").alias("width"), bits.alias("bits"))
    return rows.withColumn("keys", _flat(vc.unpacked(F.col("width"), F.col("bits"))))


@query(
    "c22_signature_sizes",
    """SELECT n, m, delta, greatest(CASE WHEN delta = 0 THEN greatest(n, m) WHEN delta = 100 THEN n + m ELSE ((n + m) * 100 + 199 - delta) // (200 - delta) END, abs(n - m)) AS hashes, least(d, n) AS on_first, d AS differences, round(1 - pow(1 - 0.001, d), 8) AS rate FROM
    (SELECT n, m, delta, greatest(CASE WHEN delta = 0 THEN 0 WHEN delta = 100 THEN n + m ELSE (((n + m) * 100 + 199 - delta) // (200 - delta) * delta + 99) // 100 END, abs(n - m)) AS d
    FROM (SELECT DISTINCT CAST(p_size AS BIGINT) * 100 AS n, CAST(p_size AS BIGINT) * 90 + 17 AS m, CAST(p_size % 6 * 20 AS BIGINT) AS delta FROM part))""",
)
def c22_sizes(spark, d):
    """Bounds from two sides' sizes and an expected difference in percent, and the rate that any of so many comparisons fails."""
    size = F.col("p_size").cast("long")
    rows = table(spark, d, "part").select((size * 100).alias("n"), (size * 90 + 17).alias("m"), (size % 6 * 20).alias("delta")).distinct()
    n, m, delta = F.col("n"), F.col("m"), F.col("delta")
    d_ = vc.most_differences(n, m, delta)
    return rows.select("n", "m", "delta", vc.most_hashes(n, m, delta).alias("hashes"), F.least(d_, n).alias("on_first"), d_.alias("differences"), F.round(vc.any_of(d_, F.lit(0.001)), 8).alias("rate"))
