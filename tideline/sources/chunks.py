"""Tables as queries see them: whole, or one epoch's files of the large ones.

Epoch-clustered copies of the large tables are made once a session, below the shared folder: rows
go to the epoch ``key mod epochs`` of their key, and every epoch has files of its own. A query
over one epoch then reads that epoch's files only, and tables with the same key are cut alike, so
joins on it need nothing from another epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.tables import load, mentioned, register
from tideline.storage import prepared

#: Cost in cents a unit, and quantity, of a part at a supplier: the part-supplier table, made from lineitem.
PS = """ps AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
         CAST(min(floor(l_extendedprice * 100 / l_quantity)) AS BIGINT) AS ps_cost, CAST(sum(l_quantity) AS BIGINT) AS ps_qty
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
#: The key whose epochs cut a table.
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "ps": "ps_partkey"}
#: A name for all of lineitem, whatever chunk ``lineitem`` stands for.
WHOLE = "all_lineitem"


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part-supplier table, aggregated once a session."""

    def write(path: str) -> None:
        register(spark, sf_dir, ["lineitem"])
        spark.sql(f"WITH {PS} SELECT * FROM ps").write.parquet(path)

    return spark.read.parquet(prepared(spark, sf_dir, "ps", write))


def base_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return part_supplier(spark, sf_dir) if table == "ps" else load(spark, sf_dir, table)


def bind(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Views of all tables that a text names, whole."""
    register(spark, sf_dir, mentioned(sql))
    words = set(re.findall(r"\w+", sql))
    if "ps" in words:
        part_supplier(spark, sf_dir).createOrReplaceTempView("ps")
    if WHOLE in words:
        load(spark, sf_dir, "lineitem").createOrReplaceTempView(WHOLE)


def clustered(spark: SparkSession, sf_dir: str, table: str, epochs: int) -> str:
    """The folder of a table's epoch-clustered copy: ``epoch=0``, ``epoch=1``, ... Large epochs are
    spread over as many files as adaptive execution finds fit."""

    def write(path: str) -> None:
        rows = base_table(spark, sf_dir, table)
        rows.withColumn("epoch", F.pmod(F.col(KEYS[table]), F.lit(epochs)).cast("int")).hint("rebalance", F.col("epoch")).write.partitionBy("epoch").parquet(path)

    return prepared(spark, sf_dir, f"{table}-{epochs}", write)


_COUNTS: dict[str, dict[int, int]] = {}


def epoch_rows(spark: SparkSession, sf_dir: str, table: str, epochs: int) -> dict[int, int]:
    """Rows of every epoch of the clustered copy, counted once, from the files' footers."""
    folder = clustered(spark, sf_dir, table, epochs)
    if folder not in _COUNTS:
        counts = spark.read.parquet(folder).groupBy("epoch").count().collect()
        _COUNTS[folder] = dict.fromkeys(range(epochs), 0) | {r.epoch: r["count"] for r in counts}
    return _COUNTS[folder]


def chunk(spark: SparkSession, sf_dir: str, table: str, epochs: int, epoch: int) -> DataFrame:
    """The rows of one epoch, from its files alone; empty if it has none."""
    schema = base_table(spark, sf_dir, table).schema
    folder = clustered(spark, sf_dir, table, epochs)
    if not epoch_rows(spark, sf_dir, table, epochs)[epoch]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/epoch={epoch}")


def bind_chunk(spark: SparkSession, sf_dir: str, sql: str, epochs: int, epoch: int, tables: list[str]) -> None:
    """As ``bind``, but ``tables`` are cut to one epoch."""
    bind(spark, sf_dir, sql)
    for table in tables:
        if re.search(rf"\b{table}\b", sql):
            chunk(spark, sf_dir, table, epochs, epoch).createOrReplaceTempView(table)
