"""Joins. The physical strategy is the optimizer's; what is here is meaning, and a size check
before a side is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a side that was counted and is small, otherwise the side as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hash_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "inner", swap: bool = False) -> DataFrame:
    """Equi-join on pairs of columns that keeps the left key columns and drops the right ones; rows
    that only the right side has (``right``, ``full``) take their keys from there. Other columns of
    the right side with a name of the left one get the suffix ``_right``. With
    ``swap`` the sides change places, so that the right table is the preserved side of an outer join;
    unmatched rows then come once, not once per chunk."""
    if swap:
        left, right, left_on, right_on = right, left, right_on, left_on
    keys = dict(zip(right_on, left_on, strict=True))
    renamed = right.withColumnsRenamed({c: f"__{c}" if c in keys else f"{c}_right" for c in right.columns if c in keys or c in left.columns})
    condition = [F.col(a) == F.col(f"__{b}") for b, a in keys.items()]
    joined = left.join(renamed, condition, how)
    if how in ("right", "rightouter", "right_outer", "full", "outer", "fullouter", "full_outer"):
        joined = joined.withColumns({a: F.coalesce(a, f"__{b}") for b, a in keys.items()})
    return joined.drop(*(f"__{b}" for b in right_on))


def merge_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner sort-merge join. Inputs with an ``epoch`` derived from the key join epoch by epoch (pass
    ``epoch`` in ``on``), so each snapshot is exact for the keys read so far."""
    return left.hint("merge").join(right, on)


def exists(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    return left.join(right, condition, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    return left.join(right, condition, "left_anti")


def single_row(df: DataFrame) -> DataFrame:
    """The one row of a table, safe to broadcast whatever was passed: none stays none, several fail."""
    n = F.col("__rows")
    one = df.agg(*(F.first(c).alias(c) for c in df.columns), F.count(F.lit(1)).alias("__rows"))
    return one.where(F.when(n > 1, F.raise_error(F.lit("one row expected, several found")).cast("boolean")).otherwise(n == 1)).drop("__rows")


def compare_scalar(rows: DataFrame, scalar: DataFrame, condition: Column) -> DataFrame:
    """Rows that hold a condition against a one-row table (an uncorrelated scalar subquery)."""
    return rows.crossJoin(F.broadcast(single_row(scalar))).where(condition).select(*rows.columns)
