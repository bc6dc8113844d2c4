"""Keys of a 128-bit ring as 32 hexadecimal digits, which sort as the numbers do; big-number arithmetic; primes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions import positional

RING = 1 << 128


def hashed(key: Column | str) -> Column:
    """A client key's place on the ring."""
    return F.md5(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary"))


def segment(key: Column, n: int) -> Column:
    """Which of n (16 at most, a power of two) equal segments of the ring a key is in, from 1."""
    return F.floor(F.conv(F.substring(key, 1, 1), 16, 10).cast("int") * n / 16).cast("int") + 1


def replicas(key: Column, n: int) -> Column:
    """The n (2, 4, 8 or 16) keys of symmetric replication: the leading digit moves by equal steps around the ring."""
    if n not in (2, 4, 8, 16):
        raise ValueError("2, 4, 8 or 16 replicas")
    first = F.conv(F.substring(key, 1, 1), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lower(F.conv(((first + i * (16 // n)) % 16).cast("string"), 10, 16)), F.substring(key, 2, 31)))


def ring_distance(a: Column, b: Column) -> Column:
    """From a on to b, around the ring: a difference of four digits of 32 bits, whose last borrow is the way around."""
    return F.when(a.isNotNull() & b.isNotNull(), positional.to_hex(positional.minus(positional.from_hex(b, 4), positional.from_hex(a, 4), 1 << 32)))


def between(a: str, b: str, part: int, parts: int) -> str:
    """The key that far on the way from a to b."""
    lo, hi = int(a, 16), int(b, 16)
    return f"{(lo + (hi - lo) % RING * part // parts) % RING:032x}"


def to_digits(n: int, base: int) -> list[int]:
    """Digits of a number, the highest first."""
    out = []
    while n or not out:
        n, d = divmod(n, base)
        out.append(d)
    return out[::-1]


def from_digits(digits: Iterable[int], base: int) -> int:
    n = 0
    for d in digits:
        n = n * base + d
    return n


def is_prime(x: Column) -> Column:
    """Deterministic Miller-Rabin for numbers of 64 bits, over Arrow batches: whole arrays at once below 2^32, where products
    fit a word; of larger numbers only those that no base divides are tested one by one."""

    def run(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        n = v[known].to_numpy(dtype="int64")
        out = primes(n)
        return pd.Series(out, v.index[known]).reindex(v.index).astype("boolean")

    return F.pandas_udf(run, "boolean")(x)


def primes(n: np.ndarray) -> np.ndarray:
    """Which of the numbers are prime."""
    out = n >= 2
    for b in BASES:
        out &= (n % b != 0) | (n == b)
    open_ = np.flatnonzero(out & (n > BASES[-1]))
    small = open_[n[open_] < 1 << 32]
    m = n[small].astype(np.uint64)
    twos = np.zeros(len(m), "i8")
    odd = m - np.uint64(1)
    while (even := odd % np.uint64(2) == 0).any():
        odd[even] //= np.uint64(2)
        twos[even] += 1
    good = np.ones(len(m), bool)
    for b in BASES[:7]:
        good &= strong(m, odd, twos, b)
    out[small] = good
    for i in open_[n[open_] >= 1 << 32].tolist():
        out[i] = prime(int(n[i]))
    return out


def strong(n: np.ndarray, odd: np.ndarray, twos: np.ndarray, base: int) -> np.ndarray:
    """Whether numbers below 2^32 (n - 1 = odd x 2^twos) pass as prime to a base."""
    x, power, left = np.ones(len(n), np.uint64), np.full(len(n), base, np.uint64) % n, odd.copy()
    while left.any():
        x = np.where(left % np.uint64(2) == 1, x * power % n, x)
        power = power * power % n
        left //= np.uint64(2)
    ok = (x == 1) | (x == n - np.uint64(1))
    for i in range(1, int(twos.max()) if len(twos) else 0):
        x = x * x % n
        ok |= (x == n - np.uint64(1)) & (i < twos)
    return ok


#: These bases decide every number below 2^64.
BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def prime(n: int) -> bool:
    if n < 2:
        return False
    for b in BASES:
        if n % b == 0:
            return n == b
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in BASES:
        x = pow(b, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True
