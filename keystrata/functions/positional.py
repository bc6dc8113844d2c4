"""Whole numbers as digits of any base, the highest first: arrays of numbers, whatever the length, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGS = "array<bigint>"


def _carried(cells: Column, base: int) -> Column:
    """Cells from the lowest up, each brought below the base by a carry that may be below 0; what the last one carries is dropped."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast(LONGS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = x + acc["c"]
        rest = F.pmod(total, F.lit(base).cast("long"))
        return F.struct(F.floor((total - rest) / F.lit(base)).cast("long").alias("c"), F.array_append(acc["out"], rest).alias("out"))

    return F.aggregate(cells, start, step, lambda acc: acc["out"])


def _aligned(a: Column, b: Column) -> tuple[Column, Column]:
    """Both numbers from the lowest digit up, the shorter filled with zeros."""
    n = F.greatest(F.size(a), F.size(b))
    fill = lambda x: F.concat(F.reverse(x).cast(LONGS), F.array_repeat(F.lit(0).cast("long"), n - F.size(x)))
    return fill(a), fill(b)


def plus(a: Column, b: Column, base: int) -> Column:
    """a + b in as many digits as the longer has; a carry beyond them is dropped."""
    x, y = _aligned(a, b)
    return F.reverse(_carried(F.zip_with(x, y, lambda p, q: p + q), base))


def minus(a: Column, b: Column, base: int) -> Column:
    """a - b in as many digits as the longer has; what is below 0 wraps around."""
    x, y = _aligned(a, b)
    return F.reverse(_carried(F.zip_with(x, y, lambda p, q: p - q), base))


def times(a: Column, b: Column, base: int) -> Column:
    """a x b in as many digits as both have; a base up to 2^30 keeps sums of products whole."""
    x, y = F.reverse(a).cast(LONGS), F.reverse(b).cast(LONGS)
    n, m = F.size(a), F.size(b)

    def cell(k: Column) -> Column:
        pairs = F.sequence(F.greatest(k - m + 1, F.lit(0)), F.least(k, n - 1))
        return F.when((k < n + m - 1), F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, i: acc + F.coalesce(F.get(x, i), F.lit(0)) * F.coalesce(F.get(y, k - i), F.lit(0)))).otherwise(F.lit(0).cast("long"))

    return F.reverse(_carried(F.transform(F.sequence(F.lit(0), n + m - 1), cell), base))


def divided(a: Column, by: Column | int, base: int) -> Column:
    """a / by, rounded down, by a number whose product with the base fits 63 bits."""
    d = F.lit(by).cast("long") if isinstance(by, int) else by.cast("long")
    start = F.struct(F.lit(0).cast("long").alias("r"), F.array().cast(LONGS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["r"] * F.lit(base) + x
        rest = total % d
        return F.struct(rest.alias("r"), F.array_append(acc["out"], F.floor((total - rest) / d).cast("long")).alias("out"))

    return F.aggregate(a.cast(LONGS), start, step, lambda acc: acc["out"])


def digits_of(x: Column, base: int, n: int) -> Column:
    """The n lowest digits of a number of up to 38 decimals."""
    big = x.cast("decimal(38,0)")
    start = F.struct(big.alias("x"), F.array().cast(LONGS).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["x"] % F.lit(base).cast("decimal(38,0)")
        return F.struct(F.call_function("div", acc["x"] - rest, F.lit(base).cast("decimal(38,0)")).cast("decimal(38,0)").alias("x"), F.array_append(acc["out"], rest.cast("long")).alias("out"))

    return F.reverse(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["out"]))


def decimal_text(digits: Column, places: int) -> Column:
    """The number in decimal, from digits of base 10^places."""
    text = F.array_join(F.transform(digits, lambda x: F.lpad(x.cast("string"), places, "0")), "")
    return F.when(F.regexp_like(text, F.lit("^0*$")), "0").otherwise(F.regexp_replace(text, "^0+", ""))


def from_hex(text: Column, parts: int) -> Column:
    """Eight hexadecimal digits each of a text as digits of base 2^32."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def to_hex(digits: Column) -> Column:
    return F.array_join(F.transform(digits, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
