"""Offline preparation of tables: delimited to Parquet, integer cents, splitting, number tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.epochs import scattered
from tideline.sources.tables import read_delimited


def delimited_to_parquet(spark: SparkSession, source: str | list[str], target: str, schema: T.StructType, sep: str = "|", order: list[str] | None = None) -> None:
    """Parquet with row-group statistics; ``order`` clusters files and rows so that they prune."""
    df = read_delimited(spark, source, schema, sep)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").parquet(target)


def integer_cents(lineitem: DataFrame) -> DataFrame:
    """Discount and tax in whole percent, price in whole units, as long integers."""
    percent = {c: F.round(F.col(c) * 100).cast("bigint") for c in ("l_discount", "l_tax")}
    return lineitem.withColumns(percent | {"l_extendedprice": F.round("l_extendedprice").cast("bigint")})


def split_rows(df: DataFrame, target: str, rows_per_file: int) -> None:
    """Parquet files of at most ``rows_per_file`` rows, without moving rows between tasks."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(target)


def number_table(spark: SparkSession, rows: int, columns: int = 10, cardinality: int = 4, seed: int = 4512763, partitions: int | None = None) -> DataFrame:
    """``ci``, ``cii``, ... uniform in [0, cardinality) and ``x``; the same rows however they are partitioned."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)

    def draw(k: int):
        return F.pmod(F.floor(scattered(F.col("id") + 1, seed + 7919 * k) / 1000), F.lit(cardinality)).cast("int")

    return base.select(*(draw(k).alias("c" + "i" * (k + 1)) for k in range(columns)), draw(columns).alias("x"))
