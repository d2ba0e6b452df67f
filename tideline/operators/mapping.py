"""User functions over snapshots: per row set, with the fraction, and once at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(df: DataFrame, function: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """A stateless map. A function that gives ``None`` drops everything, keeping the schema."""
    out = function(df)
    return df.limit(0) if out is None else out


def apply_with_fraction(df: DataFrame, progressed: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The function sees a column ``fraction``: how much of the scan the row's epoch had read."""
    return apply(df.join(F.broadcast(progressed.select("epoch", "fraction")), "epoch"), function)


def apply_at_end(df: DataFrame, function: Callable[[DataFrame], DataFrame], epochs: int) -> DataFrame:
    """Post-processing of the final snapshot only."""
    return apply(df.where(F.col("epoch") == epochs - 1), function)
