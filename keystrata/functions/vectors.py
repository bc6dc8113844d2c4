"""Vector, number and list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def unit(a: Column) -> Column:
    return scale(a, 1 / norm(a))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; no pair of numbers of 64 bits takes more than 92 steps."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def binomial(n: Column, k: Column) -> Column:
    """Exact while the result is below 2^53; each partial product is whole."""
    step = lambda acc, i: F.floor(acc * (n - k + i) / i + 0.5).cast("double")
    return F.when(k < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), step))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def round_to(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def nearest_whole(x: Column) -> Column:
    """A double rounded to a whole one, halves away from zero; what is rounded to zero keeps its sign, as in C and SQL."""
    r = F.round(x, 0)
    return F.when((r == 0) & x.cast("string").startswith("-"), F.lit(-0.0)).otherwise(r)


def whole_text(x: Column) -> Column:
    """A whole double as DuckDB writes it: negative zero with its sign, all digits below 10^16, then the fewest that read back, with an exponent (its last digit is the JDK's)."""
    minus = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    digits = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), x))
    wide = F.get(F.filter(digits, lambda s: s.cast("double") == x), F.lit(0))
    return (
        F.when(F.isnan(x), "nan")
        .when(F.abs(x) == float("inf"), F.concat(minus, F.lit("inf")))
        .when(F.abs(x) < 1e16, F.concat(minus, F.abs(x).cast("long").cast("string"), F.lit(".0")))
        .otherwise(wide)
    )


def merge_weighted(values: str, weight: str, dims: int) -> list[Column]:
    """Weighted average of vectors, a partial aggregate for each dimension."""
    return [(F.sum(F.col(values)[i] * F.col(weight)) / F.sum(weight)).alias(f"d{i}") for i in range(dims)]


def vivaldi(remote: Column, remote_error: Column, latency: Column, own: Column, own_error: Column, pull: float = 0.5, blend: float = 0.5) -> tuple[Column, Column]:
    """A network coordinate and its error after a measured latency: along the line to the other, by the share that the errors give it."""
    both = own_error + remote_error
    weight = F.when(both == 0, 0.0).otherwise(own_error / both)
    away = distance(own, remote)
    error = F.abs(away - latency) / latency * blend * weight + own_error * (1 - blend * weight)
    moved = add(own, scale(sub(own, remote), (latency - away) * pull * weight / away))
    return F.when(away == 0, own).otherwise(moved), F.when(away == 0, own_error).otherwise(error)


def most_hashes(n: Column, m: Column, delta: Column) -> Column:
    """How many different hashes two sides of n and m items have at most, if `delta` percent of the items differ (whole numbers)."""
    spread = F.floor(((n + m) * 100 + 199 - delta) / (200 - delta)).cast("long")
    expected = F.when(delta == 0, F.greatest(n, m)).when(delta == 100, n + m).otherwise(spread)
    return F.greatest(expected, F.abs(n - m))


def most_differences(n: Column, m: Column, delta: Column) -> Column:
    """How many items of both sides differ at most; a delta that the sizes refute counts as their difference."""
    spread = F.floor(((n + m) * 100 + 199 - delta) / (200 - delta)).cast("long")
    items = F.when(delta == 0, 0).when(delta == 100, n + m).otherwise(F.floor((spread * delta + 99) / 100)).cast("long")
    return F.greatest(items, F.abs(n - m))


def any_of(x: Column, p: Column) -> Column:
    """1 - (1 - p)^x, exact for small p as well."""
    return F.when((x == 0) | (p == 0), 0.0).when(p == 1, 1.0).otherwise(-F.expm1(x * F.log1p(-p)))


def packed(values: Column) -> tuple[Column, Column]:
    """Bits of each delta, and the deltas of a sorted list of whole numbers from 0 on as bits one after the other."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))
    deltas = F.zip_with(values, before, lambda x, y: x - y)
    width = F.length(F.bin(F.coalesce(F.array_max(deltas), F.lit(0))))
    return width, F.array_join(F.transform(deltas, lambda x: F.lpad(F.bin(x), width, "0")), "")


def unpacked(width: Column, bits: Column) -> Column:
    """The list that packed() made bits of."""
    n = F.floor(F.length(bits) / width).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(bits, (i * width + 1).cast("int"), width.cast("int")), 2, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.array().cast("array<bigint>")
    return F.aggregate(deltas, start, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
