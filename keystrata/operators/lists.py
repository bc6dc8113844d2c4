"""List expressions: partial reads, bag updates, element-wise helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sublist(arr: Column, start: Column, length: Column) -> Column:
    """Part of a list from a 1-based start; a start below 0 counts from the end, a length below 0 reads backwards.

    Of the places that are asked for only those that the list has are read.
    """
    n = F.size(arr)
    at = start + F.when(start > 0, 0).otherwise(n + 1)
    back = length < 0
    last = F.when(back, F.least(at, n)).otherwise(F.least(F.greatest(at, F.lit(1)) + length - 1, n))
    first = F.greatest(F.when(back, last + length + 1).otherwise(at), F.lit(1))
    part = F.slice(arr, first, F.greatest(last - first + 1, F.lit(0)))
    return F.when(back, F.reverse(part)).otherwise(part)


def without_first(arr: Column, x: Column) -> Column:
    """The list without the first occurrence of x."""
    at = F.array_position(arr, x).cast("int")
    cut = F.concat(F.slice(arr, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(arr, at + 1, F.size(arr)))
    return F.when(at > 0, cut).otherwise(arr)


def add_then_remove(old: Column, add: Column, remove: Column) -> Column:
    """Prepend `add`, then take out the first occurrence of each element of `remove`; a missing list is empty."""
    kind = F.coalesce(old, F.slice(add, 1, 0))
    return F.aggregate(remove, F.concat(add, kind), without_first)


def without_all(arr: Column, remove: Column) -> Column:
    return F.filter(arr, lambda x: ~F.array_contains(remove, x))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def blocks(arr: Column, n: int) -> Column:
    """n consecutive parts whose sizes differ by one at most, the larger first."""
    size = F.size(arr)
    small, extra = F.floor(size / n).cast("int"), (size % n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.slice(arr, (i * small + F.least(i, extra) + 1).cast("int"), (small + F.when(i < extra, 1).otherwise(0)).cast("int")),
    )


def set_nth(arr: Column, i: Column, x: Column) -> Column:
    return F.transform(arr, lambda v, j: F.when(j + 1 == i, x).otherwise(v))


def remove_at(arr: Column, at: Column) -> Column:
    """Without the elements at 1-based places."""
    kept = F.filter(F.transform(arr, lambda v, j: F.struct(v.alias("v"), (j + 1).alias("j"))), lambda s: ~F.array_contains(at, s["j"]))
    return F.transform(kept, lambda s: s["v"])


def index_of(arr: Column, x: Column) -> Column:
    return F.array_position(arr, x)


def take_with(arr: Column, test) -> Column:
    """The first element that passes, and the list without it; null where none does."""
    at = F.array_position(F.transform(arr, lambda x: F.coalesce(test(x), F.lit(False))), True).cast("int")
    return F.when(at > 0, F.struct(F.element_at(arr, at).alias("taken"), F.concat(F.slice(arr, F.lit(1), at - 1), F.slice(arr, at + 1, F.size(arr))).alias("rest")))


def partition3(arr: Column, order) -> Column:
    """Elements for which order(x) is below, at, and above 0."""
    return F.struct(*(F.filter(arr, t).alias(n) for n, t in (("below", lambda x: order(x) < 0), ("at", lambda x: order(x) == 0), ("above", lambda x: order(x) > 0))))


def key_store(pairs: Column, key: Column, value: Column) -> Column:
    """Pairs (k, v) with the first of that key replaced, or the new one at the end."""
    at = F.array_position(F.transform(pairs, lambda p: p["k"] == key), True).cast("int")
    new = F.struct(key.alias("k"), value.alias("v"))
    return F.when(at > 0, F.transform(pairs, lambda p, i: F.when(i + 1 == at, new).otherwise(p))).otherwise(F.concat(pairs, F.array(new)))
