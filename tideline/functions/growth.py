"""Growth of group sizes with the fraction read, and final counts predicted from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.progressive import DEFAULT_COUNT


def growth_fit(snaps: DataFrame, progressed: DataFrame, count: str = DEFAULT_COUNT) -> DataFrame:
    """``epoch, fraction, power, slope_var``: per epoch the least-squares line of ``ln(mean group
    size)`` over ``ln(fraction)`` through all epochs so far. One point has power 0. The window is
    over one row an epoch, which is why it may be unpartitioned."""
    points = snaps.groupBy("epoch").agg((F.sum(count) / F.count(F.lit(1))).alias("size")).join(F.broadcast(progressed), "epoch")
    points = points.select("epoch", "fraction", F.log("fraction").alias("x"), F.log("size").alias("y"))
    past = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, sxx, sxy, syy = (f("y", "x").over(past) for f in (F.regr_count, F.regr_sxx, F.regr_sxy, F.regr_syy))
    safe = F.when(sxx > 0, sxx)
    residual = (syy - sxy * sxy / safe) / (n * safe)
    return points.select("epoch", "fraction", F.coalesce(F.regr_slope("y", "x").over(past), F.lit(0.0)).alias("power"), residual.alias("slope_var"))


def line_fit(points: list[tuple[float, float]]) -> tuple[float, float | None]:
    """``power`` and ``slope_var`` of the line through (ln fraction, ln mean group size), as ``growth_fit``
    gives them for the last of the points."""
    x, y = np.array(points, float).T if points else (np.empty(0), np.empty(0))
    if len(x) < 2:
        return 0.0, None
    dx, dy = x - x.mean(), y - y.mean()
    sxx, sxy, syy = float(dx @ dx), float(dx @ dy), float(dy @ dy)
    if sxx <= 0:
        return 0.0, None
    return sxy / sxx, (syy - sxy * sxy / sxx) / (len(x) * sxx)


def final_count(n: Column, fraction: Column, power: Column) -> Column:
    """Rows a group will have at the end: ``round(n / fraction^power)``; power 0 leaves it."""
    return F.when((power == 0) | (fraction == 0), n.cast("double")).otherwise(F.round(n / F.pow(fraction, power)))


def count_variance(estimate: Column, fraction: Column, slope_var: Column) -> Column:
    return slope_var * estimate * estimate * F.log(F.lit(1.0) / fraction)


def fixed_power(progressed: DataFrame, power: float) -> DataFrame:
    """A fit that is known beforehand: 0 for complete input, 1 for rows that grow linearly."""
    return progressed.select("epoch", "fraction", F.lit(float(power)).alias("power"), F.lit(0.0).alias("slope_var"))
