"""Scaling of snapshots to predicted final values, with variances and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.growth import count_variance, final_count
from tideline.operators.progressive import DEFAULT_COUNT


def chebyshev(confidence: float = 0.95) -> float:
    """Half width of the interval in standard deviations, for any distribution."""
    return math.sqrt(1 / (1 - confidence))


def scale(snaps: DataFrame, fit: DataFrame, sums: list[str], counts: list[str] = (), variance: bool = False, count: str = DEFAULT_COUNT) -> DataFrame:
    """Snapshots with ``<c>_sum`` of ``sums`` scaled to ``sum / n * n_final`` and ``n_final`` added;
    ``counts`` are columns replaced by ``n_final``; minima, maxima and averages need no scaling. With
    ``variance`` also ``n_final_var``, ``<c>_sum_var`` and ``<a>_<b>_cov`` of the scaled sums."""
    out = snaps.join(F.broadcast(fit), "epoch").withColumn("n_final", final_count(F.col(count), F.col("fraction"), F.col("power")))
    n, final = F.col(count), F.col("n_final")
    if variance:
        spread = count_variance(final, F.col("fraction"), F.col("slope_var"))
        out = out.withColumn("n_final_var", spread)
        made: dict[str, Column] = {}
        for i, a in enumerate(sums):
            mean = F.col(f"{a}_sum") / n
            made[f"{a}_sum_var"] = F.col(f"{a}_var") / n * final * final + F.col("n_final_var") * mean * mean
            for b in sums[i + 1 :]:
                made[f"{a}_{b}_cov"] = F.col("n_final_var") * mean * (F.col(f"{b}_sum") / n)
        out = out.withColumns(made)
    return out.withColumns({f"{c}_sum": F.col(f"{c}_sum") / n * final for c in sums} | {c: final for c in counts})


def ratio_variance(a: Column, b: Column, var_a: Column, var_b: Column, cov: Column) -> Column:
    """Variance of ``a / b`` by the delta method."""
    b = F.nullif(b, F.lit(0.0))
    a = F.nullif(a, F.lit(0.0))
    share = a / b
    return share * share * (var_a / (a * a) + var_b / (b * b) - 2 * cov / (a * b))


def half_width(variance: Column, confidence: float = 0.95) -> Column:
    return F.lit(chebyshev(confidence)) * F.sqrt(F.greatest(variance, F.lit(0.0)))
