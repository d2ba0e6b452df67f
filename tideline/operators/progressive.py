"""Snapshots: the aggregate over all rows of the epochs so far, for every epoch, in one job.

Rows are aggregated per epoch and key first (map-side combined, one shuffle of partial results);
each partial result is then counted in its own and all later epochs. A group is thereby in every
snapshot from its first on, without a join or a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.epochs import later

DEFAULT_COUNT = "group_rows"


def partials(rows: DataFrame, keys: list[str], sums: list[str], mins: list[str] = (), maxs: list[str] = (), variance: bool = False) -> DataFrame:
    """Delta per ``epoch`` and key: row count, sums, minima and maxima and, for ``variance``, per
    summed column ``n * mean`` and ``n * (sample variance + mean^2)`` (one row: variance 0)."""
    aggs = [F.count(F.lit(1)).alias(DEFAULT_COUNT), *(F.sum(c).alias(f"{c}_sum") for c in sums), *(F.min(c).alias(f"{c}_min") for c in mins), *(F.max(c).alias(f"{c}_max") for c in maxs)]
    if variance:
        for c in sums:
            x = F.col(c).cast("double")
            aggs += [F.sum(x).alias(f"{c}_m1"), (F.count(F.lit(1)) * (F.coalesce(F.var_samp(x), F.lit(0.0)) + F.avg(x) * F.avg(x))).alias(f"{c}_m2")]
    return rows.groupBy("epoch", *keys).agg(*aggs)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results of equal keys as one: counts and sums add up, minima and maxima merge."""
    types = dict(parts.dtypes)
    how = {c: F.min if c.endswith("_min") else F.max if c.endswith("_max") else F.sum for c in parts.columns if c not in keys}
    return parts.groupBy(*keys).agg(*(f(c).cast(types[c]).alias(c) for c, f in how.items()))


def accumulate(delta: DataFrame, keys: list[str], epochs: int) -> DataFrame:
    """Snapshots from deltas: a delta counts in its own and all later epochs."""
    return merged(delta.select(later(epochs).alias("epoch"), *(c for c in delta.columns if c != "epoch")), ["epoch", *keys])


def finished(grown: DataFrame, sums: list[str], variance: bool = False) -> DataFrame:
    """Merged partial results with ``<c>_sum`` as double and, for ``variance``, ``<c>_mean`` and the
    pooled ``<c>_var``."""
    n = F.col(DEFAULT_COUNT)
    made: dict[str, Column] = {f"{c}_sum": F.col(f"{c}_sum").cast("double") for c in sums}
    if variance:
        made |= {f"{c}_mean": F.col(f"{c}_m1") / n for c in sums}
        made |= {f"{c}_var": F.greatest(F.col(f"{c}_m2") / n - (F.col(f"{c}_m1") / n) * (F.col(f"{c}_m1") / n), F.lit(0.0)) for c in sums}
    return grown.withColumns(made).drop(*(f"{c}_m{i}" for c in sums for i in (1, 2)))


def snapshots(rows: DataFrame, keys: list[str], sums: list[str], epochs: int, mins: list[str] = (), maxs: list[str] = (), variance: bool = False) -> DataFrame:
    """``epoch``, keys, ``group_rows``, ``<c>_sum`` (as double), ``<c>_min``, ``<c>_max`` and, for
    ``variance``, the pooled ``<c>_var`` and ``<c>_mean``. A snapshot must never be accumulated again:
    a second level groups by ``epoch`` as well."""
    return finished(accumulate(partials(rows, keys, sums, mins, maxs, variance), keys, epochs), sums, variance)


def blocked(snaps: DataFrame, epochs: int) -> DataFrame:
    """Keep-last blocking: only the final snapshot."""
    return snaps.where(F.col("epoch") == epochs - 1).drop("epoch")


def blocked_rows(deltas: list[DataFrame]) -> DataFrame:
    """Collecting blocking: all deltas as one table."""
    return reduce(DataFrame.unionByName, deltas)


def pair_snapshots(left: DataFrame, right: DataFrame, mode: str = "both") -> DataFrame:
    """Two snapshot tables side by side: at the same epoch (``both``), every left epoch with the
    right's first (``left``), or with the right's last (``right_end``). Columns must differ but for
    ``epoch``. Epochs are few, so the join is on a tiny key set; sides keep their groups."""
    if mode == "both":
        return left.join(right, "epoch")
    ends = right.agg((F.min if mode == "left" else F.max)("epoch").alias("pick"))
    chosen = right.join(F.broadcast(ends), right.epoch == ends.pick, "left_semi").drop("epoch")
    return left.crossJoin(chosen)
