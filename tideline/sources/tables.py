"""Readers: table resolution, natural file order, format sniffing, explicit schemas, sinks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.storage import materialize, write_single, write_text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table; ``columns`` prunes the scan. Unknown tables raise ``ValueError``."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def register(spark: SparkSession, sf_dir: str, tables: Iterable[str] = TABLES) -> None:
    """Temporary views of the tables. A DataFrame made from them keeps its files when another
    directory is registered later."""
    for table in tables:
        load(spark, sf_dir, table).createOrReplaceTempView(table)


def mentioned(sql: str) -> list[str]:
    """The tables a text names."""
    words = set(re.findall(r"\w+", sql))
    return [t for t in TABLES if t in words]


def natural_key(path: str) -> list:
    """Orders part-10 after part-9."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def list_files(spark: SparkSession, folder: str, table: str) -> list[str]:
    """``{folder}/{table}.*`` in natural order, through Hadoop's file system API."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{folder}/{table}.*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted((str(x.getPath()) for x in found or []), key=natural_key)


def sniff_format(files: list[str]) -> str:
    """``parquet`` if the first file is called so, else ``csv``."""
    return "parquet" if files and ".parquet" in files[0].rsplit("/", 1)[-1] else "csv"


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",", header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """CSV or ``.tbl`` files with an explicit schema (no inference pass). A trailing separator's
    empty column is ignored. Column pruning reaches the CSV parser."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, mode="PERMISSIVE", enforceSchema=True)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, folder: str, table: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Finds a table's files, sniffs their format and reads them; ``file_order`` is the place of
    a row's file in natural order."""
    files = list_files(spark, folder, table)
    if not files:
        raise FileNotFoundError(f"no files for table {table!r} in {folder}")
    df = spark.read.schema(schema).parquet(*files) if sniff_format(files) == "parquet" else read_delimited(spark, files, schema, "|")
    names = F.array(*(F.lit(f.rsplit("/", 1)[-1]) for f in files))
    df = df.select(*schema.names, (F.array_position(names, F.col("_metadata.file_name")) - 1).cast("int").alias("file_order"))
    return df.select(*columns, "file_order") if columns else df


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    write_single(df, path, lambda rows, folder: write_delimited(rows, folder))


def write_epochs(snapshots: DataFrame, path: str, experiment: str = "latency") -> None:
    """CSV sink of a table of snapshots: ``final.csv``, the last one; for an accuracy run also
    ``0.csv``, ``1.csv``, ... for every epoch."""
    epochs = sorted(r.epoch for r in snapshots.select("epoch").distinct().collect())
    for epoch in epochs:
        rows = snapshots.where(F.col("epoch") == epoch).drop("epoch")
        if experiment == "accuracy":
            write_csv_file(rows, f"{path}/{epoch}.csv")
        if epoch == epochs[-1]:
            write_csv_file(rows, f"{path}/final.csv")


def write_estimates(run: Iterable[tuple[int, float, DataFrame]], path: str, experiment: str = "latency") -> list[int]:
    """Runs through the estimates of a query as they come, writes ``final.csv`` (for an accuracy run also
    one file per estimate) and returns the time of every estimate in ns since the start. An estimate is
    computed once; writing a file of it is not part of its time."""
    began, writing, times = time.perf_counter_ns(), 0, []
    last = None
    for number, _, df in run:
        last = materialize(df.drop("epoch"), "estimate")
        now = time.perf_counter_ns()
        times.append(now - began - writing)
        if experiment == "accuracy":
            write_csv_file(last, f"{path}/{number}.csv")
        writing += time.perf_counter_ns() - now
    if last is not None:
        write_csv_file(last, f"{path}/final.csv")
    return times


def write_timing(spark: SparkSession, path: str, result_dir: str, measures_ns: list[int]) -> None:
    """Timing sink of a run: one time per emitted estimate."""
    write_text(spark, path, json.dumps({"result_dir": result_dir, "time_measures_ns": measures_ns}))
