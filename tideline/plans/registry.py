"""All queries of the library itself and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans import operators, progressive
from tideline.plans.run import sql_query
from tideline.plans.tpch import EXACT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: sql_query(text) for name, text in EXACT.items()} | progressive.QUERIES | operators.QUERIES
ORACLE_SQL: dict[str, str] = EXACT | progressive.ORACLE_SQL | operators.ORACLE_SQL
