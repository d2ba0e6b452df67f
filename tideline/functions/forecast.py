"""Forecasts of a series (t, v) at a target time, after each of its points.

Last value, running mean, least-squares line and mean trend are window expressions; exponential
smoothing and the selector are recursive and run per series in ``applyInPandas`` (one group is one
series of estimates, as long as there are epochs)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth(times: np.ndarray, values: np.ndarray, base: float = 0.5) -> np.ndarray:
    """Weighted mean of the values so far; weights decay by ``base`` per unit of the first time."""
    total = weight = 0.0
    out = np.empty(len(times))
    for i, (t, v) in enumerate(zip(times, values, strict=True)):
        decay = base ** ((t - times[i - 1]) / times[0]) if i else 0.0
        total, weight = total * decay + v, weight * decay + 1
        out[i] = total / weight
    return out


def running_mean(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values) / np.arange(1, len(values) + 1)


def lines(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of the least-squares line through the points so far; one point is flat."""
    n = np.arange(1, len(times) + 1)
    mt, mv = running_mean(times), running_mean(values)
    var = np.cumsum(times * times) / n - mt * mt
    cov = np.cumsum(times * values) / n - mt * mv
    slope = np.divide(cov, var, out=np.zeros(len(times)), where=var > 1e-12 * np.maximum(1, mt * mt))
    return slope, mv - slope * mt


def trends(times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Slope of every step; the first starts at the origin."""
    return np.diff(values, prepend=0.0) / np.diff(times, prepend=0.0)


def candidates(times: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The selector's models, as (slope, value at the current time) after every point: last value,
    mean, smoothed mean, line, and the last value with last, mean and smoothed trend."""
    flat = np.zeros(len(times))
    slope, start = lines(times, values)
    step = trends(times, values)
    return [
        (flat, values), (flat, running_mean(values)), (flat, smooth(times, values, 0.75)), (slope, start + slope * times),
        (step, values), (running_mean(step), values), (smooth(times, step, 0.5), values),
    ]


def select_forecast(times: np.ndarray, values: np.ndarray, target: float) -> np.ndarray:
    """Per point the forecast at ``target`` by the model with the least smoothed squared error of its
    forecasts one step ahead. Models are trained up to the point before; the first point
    stands for itself; among equals the last model wins."""
    out = np.empty(len(times))
    models = candidates(times, values)
    errors = []
    for slope, now in models:
        ahead = now[:-1] + slope[:-1] * np.diff(times)
        errors.append(smooth(times[:-1], (values[1:] - ahead) ** 2, 0.75) if len(times) > 1 else np.empty(0))
    for i in range(len(times)):
        if i == 0:
            out[i] = values[0]
            continue
        scores = [e[i - 1] for e in errors]
        best = max(k for k, s in enumerate(scores) if s == min(scores))
        slope, now = models[best]
        out[i] = now[i - 1] + slope[i - 1] * (target - times[i - 1])
    return out


def recursive_forecast(series: DataFrame, keys: list[str], target: float, method: str = "selector") -> DataFrame:
    """``keys, t, v`` with ``forecast``; ``method`` is ``ses`` (smoothed mean), ``trend_ses`` (smoothed trend
    from the last value) or ``selector``. Several value columns are forecast by unpivoting them into
    keys first."""
    methods = {"ses": smooth, "trend_ses": lambda t, v: v + smooth(t, trends(t, v)) * (target - t), "selector": lambda t, v: select_forecast(t, v, target)}
    made = methods[method]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable")
        t, v = group["t"].to_numpy(float), group["v"].to_numpy(float)
        return group.assign(forecast=made(t, v))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in series.dtypes) + ", forecast double"
    if keys:
        return series.groupBy(*keys).applyInPandas(work, schema)
    return series.groupBy(F.lit(0)).applyInPandas(work, schema)


def forecast_columns(series: DataFrame, keys: list[str], columns: list[str], target: float, method: str = "selector") -> DataFrame:
    """Row forecast: several value columns of ``keys, t`` at once, one estimator per column and key."""
    long = series.unpivot([*keys, "t"], columns, "column", "v").withColumn("v", F.col("v").cast("double"))
    done = recursive_forecast(long, [*keys, "column"], target, method)
    return done.groupBy(*keys, "t").pivot("column", columns).agg(F.first("forecast"))


def window_forecast(series: DataFrame, keys: list[str], target: float, method: str) -> DataFrame:
    """``tail``, ``mean``, ``ols``, ``trend`` or ``trend_last`` (mean or last trend from the last value), as
    window expressions."""
    order = Window.partitionBy(*keys).orderBy("t")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, v = F.col("t"), F.col("v")
    if method == "tail":
        made = v
    elif method == "mean":
        made = F.avg("v").over(past)
    elif method == "ols":
        slope = F.coalesce(F.regr_slope("v", "t").over(past), F.lit(0.0))
        made = F.avg("v").over(past) + slope * (target - F.avg("t").over(past))
    elif method in ("trend", "trend_last"):
        step = (v - F.coalesce(F.lag("v").over(order), F.lit(0.0))) / (t - F.coalesce(F.lag("t").over(order), F.lit(0.0)))
        return series.withColumn("step", step).withColumn("forecast", v + (F.avg("step").over(past) if method == "trend" else F.col("step")) * (target - t)).drop("step")
    else:
        raise ValueError(f"unknown method {method!r}")
    return series.withColumn("forecast", made)


def line_criteria(series: DataFrame, keys: list[str]) -> DataFrame:
    """Information criteria of the least-squares line through each series: ``n``, residual sum of squares
    ``rss``, log-likelihood of normal residuals, ``aic``, ``aicc`` and ``bic``; the line has three parameters
    (slope, intercept, spread). Series of fewer than five points, or without residuals, have none."""
    fit = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.regr_syy("v", "t") - F.regr_sxy("v", "t") ** 2 / F.nullif(F.regr_sxx("v", "t"), F.lit(0.0))).alias("rss"))
    n, k = F.col("n"), 3
    likely = F.when((n > k + 1) & (F.col("rss") > 0), -n / 2 * (F.log(2 * np.pi * F.col("rss") / n) + 1))
    fit = fit.withColumn("loglik", likely).withColumn("aic", 2 * k - 2 * F.col("loglik"))
    return fit.withColumns({"aicc": F.col("aic") + (2 * k * k + 2 * k) / (n - k - 1), "bic": k * F.log(n) - 2 * F.col("loglik")})
