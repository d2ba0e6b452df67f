"""Accuracy of a sequence of estimates against a reference answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import single_row


def final_snapshot(results: DataFrame) -> DataFrame:
    """The last epoch's rows: the exact answer if every inner aggregate is per snapshot."""
    last = results.agg(F.max("epoch").alias("last"))
    return results.join(F.broadcast(last), results.epoch == last.last, "left_semi").drop("epoch")


def accuracy(results: DataFrame, keys: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Per epoch ``mape`` (percent, over rows whose reference is not 0), ``mae`` (times 100),
    ``recall`` and ``precision`` (percent of the keys). Without keys the answer is one row and recall and
    precision are those of that row."""
    reference = final_snapshot(results) if reference is None else reference
    values = [c for c in results.columns if c != "epoch" and c not in keys]
    ref = reference.select(*keys, *(F.col(c).alias(f"ref_{c}") for c in values))
    both = results.join(ref, keys) if keys else results.crossJoin(F.broadcast(single_row(ref)))
    off = [F.abs(F.col(c) - F.col(f"ref_{c}")) for c in values]
    shares = [F.when(F.col(f"ref_{c}") != 0, o / F.abs(F.col(f"ref_{c}"))) for c, o in zip(values, off, strict=True)]

    def total(columns, f):
        return reduce(lambda a, b: a + b, [f(c) for c in columns], F.lit(0))

    share_sum, share_n = total(shares, lambda c: F.coalesce(F.sum(c), F.lit(0.0))), total(shares, F.count)
    off_sum, off_n = total(off, lambda c: F.coalesce(F.sum(c), F.lit(0.0))), total(off, F.count)
    hits = both.groupBy("epoch").agg((100 * F.try_divide(share_sum, share_n)).alias("mape"), (100 * F.try_divide(off_sum, off_n)).alias("mae"), F.count(F.lit(1)).alias("hit"))
    sizes = results.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows"))
    expected = reference.agg(F.count(F.lit(1)).alias("expected"))
    out = sizes.join(hits, "epoch", "left").crossJoin(F.broadcast(expected))
    hit = F.coalesce("hit", F.lit(0))
    return out.select("epoch", "mape", "mae", (100 * F.try_divide(hit, "expected")).alias("recall"), (100 * F.try_divide(hit, "rows")).alias("precision"))


def coverage(results: DataFrame, keys: list[str], value: str, half: str, truth: DataFrame) -> DataFrame:
    """Per epoch the share of estimates whose interval ``value +- half`` holds the truth (column
    ``value`` of ``truth``), for one run or many (more rows per epoch and key)."""
    exact = truth.select(*keys, F.col(value).alias("exact"))
    both = results.join(exact, keys) if keys else results.crossJoin(F.broadcast(single_row(exact)))
    inside = F.abs(F.col(value) - F.col("exact")) <= F.col(half)
    return both.groupBy("epoch").agg(F.avg(inside.cast("double")).alias("covered"), F.count(F.lit(1)).alias("estimates"))
