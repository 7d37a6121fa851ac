"""Exact binomial tails as column expressions.

ln n! comes from Stirling's series, whose error below n = 10 is removed by shifting the argument, so a
tail needs no table and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """ln n! for integers n >= 0."""
    x = n.cast("double") + 1.0  # ln gamma(x)
    shift = 9
    z = x + float(shift)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    product = x
    for k in range(1, shift):
        product = product * (x + float(k))
    return series - F.log(product)


def lower_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k): 0 for k < 0, 1 for k >= n, 1 at p = 0 and 0 at p = 1 otherwise.

    The sum runs away from k on the side where the terms fall (below k where k <= n p, else above it, as
    the complement), each term from the one before by a ratio (a - j) / (b + j) q.  The ratios fall, so the
    terms end where the geometric or the normal bound has passed the precision of a double: a few dozen
    terms, or about ten standard deviations near k = n p.
    """
    k, n = k.cast("double"), n.cast("double")
    below = k <= n * p
    first = F.when(below, k).otherwise(k + 1)
    a, b = F.when(below, k).otherwise(n - k - 1), F.when(below, n - k + 1).otherwise(k + 2)
    q = F.when(below, (1 - p) / p).otherwise(p / (1 - p))
    ratio = a / b * q
    spread = 10 * F.sqrt(n * p * (1 - p)) + 60
    terms = F.when(ratio <= 0, 1).otherwise(F.least(a, spread, 42 / -F.log(ratio) + 2)).cast("int")
    head = F.exp(ln_factorial(n) - ln_factorial(first) - ln_factorial(n - first) + first * F.log(p) + (n - first) * F.log1p(-p))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] * (a - j) / (b + j) * q
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = head * F.aggregate(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), start, add)["s"]
    total = F.least(F.when(below, total).otherwise(1 - total), F.lit(1.0))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(p <= 0, 1.0).when(p >= 1, 0.0).otherwise(total)


def least_sample(level: float, alpha: float) -> int:
    """Smallest number of flawless answers that certifies risk alpha at a level."""
    return math.ceil(math.log(level) / math.log(1 - alpha))
