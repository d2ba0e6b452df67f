"""Estimates of the final number of distinct values from the part that was read."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digamma(x: float) -> float:
    """By recurrence up to 6 and the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def miss(q: float, n: float, total: float) -> float:
    """Probability that a value with ``q`` of ``total`` rows is not among ``n`` rows drawn."""
    if total - n - q + 1 <= 0:
        return 0.0
    return math.exp(math.lgamma(total - q + 1) + math.lgamma(total - n + 1) - math.lgamma(total - n - q + 1) - math.lgamma(total + 1))


def moment_estimate(d: float, n: float, total: float) -> float:
    """The number x of equally frequent values that would show ``d`` distinct ones in ``n`` of
    ``total`` rows: the root of ``x * (1 - miss(total / x)) = d``, found between d and total."""
    if d == n or math.floor(total) <= n or d <= 0:
        return d

    def gap(x: float) -> float:
        return x * (1 - miss(total / x, n, total)) - d

    low, high = float(d), float(total)
    if gap(high) < 0:
        return high
    x = low
    for _ in range(60):
        h = miss(total / x, n, total)
        q = total / x
        inside = total - n - q + 1
        slope = 1 - h - (h * q * (digamma(total - q + 1) - digamma(inside)) if inside > 0 else 0.0)
        value = x * (1 - h) - d
        low, high = (x, high) if value < 0 else (low, x)
        new = x - value / slope if slope > 0 else x
        new = new if low < new < high else (low + high) / 2
        if abs(new - x) < 1e-6 * x:
            return min(new, total)
        x = new
    return min(x, total)


def horvitz_thompson(n_j: float, n: float, fraction: float) -> float:
    """Share of one seen value in the estimate: the inverse of its probability to be seen."""
    total = n / fraction
    final = n_j / fraction
    if fraction >= 1 or total < n + final:
        return 1.0
    return 1 / max(1e-12, 1 - miss(final, n, total))


@F.pandas_udf(T.DoubleType())
def moment_udf(d: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([moment_estimate(*x) for x in zip(d.astype(float), n.astype(float), total.astype(float), strict=True)], dtype=float)


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series, eight steps further on."""
    y = x + 8.0
    steps = reduce(lambda a, b: a * b, [x + float(i) for i in range(8)])
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def missed(q: Column, n: Column, total: Column) -> Column:
    """``miss`` as a column."""
    left = total - n - q + 1
    return F.when(left <= 0, F.lit(0.0)).otherwise(F.exp(lgamma(total - q + 1) + lgamma(total - n + 1) - lgamma(left) - lgamma(total + 1)))


def horvitz_share(n_j: Column, n: Column, fraction: Column) -> Column:
    """``horvitz_thompson`` as a column."""
    total, final = n / fraction, n_j / fraction
    return F.when((fraction >= 1) | (total < n + final), F.lit(1.0)).otherwise(1 / F.greatest(F.lit(1e-12), 1 - missed(final, n, total)))


def distinct_counts(value_snaps: DataFrame, fit: DataFrame, keys: list[str], method: str = "moment") -> DataFrame:
    """``epoch``, keys, ``seen`` and ``estimate`` from snapshots per key *and value* (``group_rows``) and
    the growth fit of the keys' totals. At fraction 1 the count is exact. The sums are native; only
    the root finding runs in a vectorised function, once per epoch and key."""
    joined = value_snaps.join(F.broadcast(fit), "epoch")
    if method == "horvitz":
        totals = value_snaps.groupBy("epoch", *keys).agg(F.sum("group_rows").alias("n"))
        each = joined.join(totals, ["epoch", *keys])
        share = horvitz_share(F.col("group_rows"), F.col("n"), F.col("fraction"))
        return each.withColumn("share", share).groupBy("epoch", *keys).agg(F.count(F.lit(1)).alias("seen"), F.sum("share").alias("estimate"))
    sums = joined.groupBy("epoch", "fraction", "power", *keys).agg(F.count(F.lit(1)).alias("seen"), F.sum("group_rows").alias("n"))
    total = F.when(F.col("power") == 0, F.col("n").cast("double")).otherwise(F.round(F.col("n") / F.pow("fraction", "power")))
    estimate = F.when(F.col("fraction") >= 1, F.col("seen").cast("double")).otherwise(moment_udf("seen", "n", total))
    return sums.select("epoch", *keys, "seen", estimate.alias("estimate"))
