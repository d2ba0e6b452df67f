"""Epochs: the chunks of a scan, as a column, and how much of the scan they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_epochs(df: DataFrame, epochs: int, key: str) -> DataFrame:
    """``epoch = key mod epochs``: all rows of a key, also of other tables with it, share an epoch."""
    return df.withColumn("epoch", F.pmod(F.col(key), F.lit(epochs)).cast("int"))


#: A multiplicative generator modulo a prime scatters keys; any SQL engine can say it.
PRIME, FACTOR = 2147483647, 48271


def _factor(seed: int) -> int:
    """Another multiplier for every seed."""
    return pow(FACTOR, 2 * seed + 1, PRIME)


def scattered(key: Column, seed: int) -> Column:
    """A number from 0 to PRIME - 1 for every whole key."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(PRIME)) * F.lit(_factor(seed)), F.lit(PRIME))


def scattered_sql(key: str, seed: int) -> str:
    """The same for keys that are not negative."""
    return f"((({key}) % {PRIME}) * {_factor(seed)} % {PRIME})"


def shuffled_epochs(df: DataFrame, epochs: int, key: str, seed: int) -> DataFrame:
    """A seeded random order of chunks; a key still stays in one epoch."""
    place = F.floor(scattered(F.col(key), seed) / (F.lit(PRIME) / F.lit(epochs)))
    return df.withColumn("epoch", F.least(place, F.lit(epochs - 1)).cast("int"))


def row_epochs(df: DataFrame, epochs: int, total: int | None = None) -> DataFrame:
    """Chunks in the order of a single Parquet file's rows (``_metadata.row_index``)."""
    total = df.count() if total is None else total
    place = F.col("_metadata.row_index")
    return df.select("*", F.least(F.floor(place * epochs / F.lit(max(total, 1))), F.lit(epochs - 1)).cast("int").alias("epoch"))


def file_epochs(df: DataFrame, order: str = "file_order") -> DataFrame:
    """One epoch per file, in natural order (``sources.tables.read_table``)."""
    return df.withColumnRenamed(order, "epoch")


def later(epochs: int, epoch: str = "epoch") -> Column:
    """The snapshots a row belongs to: its own epoch and all later ones."""
    return F.explode(F.sequence(F.col(epoch), F.lit(epochs - 1)))


def progress(scan: DataFrame, epochs: int) -> DataFrame:
    """``epoch, rows, fraction`` of the *unfiltered* base scan, for every epoch; the last fraction is
    exactly 1. A scan of known size needs no count: pass its epochs only (pruned to one column)."""
    own = scan.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows"))
    seen = own.select(later(epochs).alias("epoch"), "rows").groupBy("epoch").agg(F.sum("rows").alias("rows"))
    total = own.agg(F.sum("rows").alias("total"))
    return seen.crossJoin(F.broadcast(total)).select("epoch", "rows", (F.col("rows") / F.col("total")).alias("fraction"))
