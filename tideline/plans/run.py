"""SQL texts as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.sources.chunks import PS, bind


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function of the driver's form from a SQL text; only the tables it names are bound. The
    part-supplier table, which the text defines for engines without it, is the prepared one."""
    own = text.replace(f"WITH {PS}, ", "WITH ").replace(f"WITH {PS}", "")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind(spark, sf_dir, own)
        return spark.sql(own)

    return run
