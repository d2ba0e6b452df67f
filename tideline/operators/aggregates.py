"""Aggregates beyond ``groupBy``: ordered first and last, keep-first, argmax with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import broadcast_if_small


def first_last(df: DataFrame, keys: list[str], column: str, order: list[str]) -> DataFrame:
    """First and last value of a column in a total order; map-side combined (no sort of groups)."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(column, at).alias(f"{column}_first"), F.max_by(column, at).alias(f"{column}_last"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in a total order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def argmax(df: DataFrame, value: str, within: list[str] = (), most_rows: int = 100_000) -> DataFrame:
    """All rows with the largest value (per ``within``, e.g. ``epoch``); ties are kept. The largest
    values are aggregated on the map side and joined back, so few groups do not mean few tasks; they
    are broadcast if they are counted and at most ``most_rows``."""
    best = df.groupBy(*within).agg(F.max(value).alias("__top"))
    match = [F.col(value) == F.col("__top"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within)]
    best = best.withColumnsRenamed({c: f"__{c}" for c in within})
    return df.join(broadcast_if_small(best, most_rows) if within else F.broadcast(best), match, "left_semi")
