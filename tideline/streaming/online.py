"""Online statements: one sum or count, with its interval, until a time budget is spent.

    SELECT ONLINE SUM(expression) FROM tables WHERE condition WITHTIME ms CONFIDENCE percent REPORTINTERVAL ms
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tideline.functions.scaling import chebyshev
from tideline.plans.progressive import P, Plan, estimates
from tideline.sources.chunks import KEYS

STATEMENT = re.compile(
    r"\s*SELECT\s+ONLINE\s+(SUM|COUNT)\s*\((.+)\)\s+FROM\s+(.+?)\s+WHERE\s+(.+?)\s+WITHTIME\s+(\d+)\s+CONFIDENCE\s+(\d+(?:\.\d+)?)(?:\s+REPORTINTERVAL\s+(\d+))?\s*;?\s*",
    re.IGNORECASE | re.DOTALL,
)


@dataclass
class Report:
    """An estimate, half the width of its interval (none while the spread is unknown), the part of the
    scan that is read and the seconds since the start."""

    epoch: int
    estimate: float
    half: float | None
    fraction: float
    seconds: float


@dataclass
class Statement:
    plan: Plan
    seconds: float
    every: float


def parse(text: str) -> Statement:
    """Statements of another form raise ``ValueError``. The tables must hold lineitem or orders."""
    found = STATEMENT.fullmatch(text)
    if not found:
        raise ValueError("not a SELECT ONLINE statement")
    how, what, tables, condition, budget, level, every = found.groups()
    names = [t.strip() for t in tables.split(",")]
    table = next((t for t in ("lineitem", "orders") if t in names), None)
    if table is None:
        raise ValueError("an online statement reads lineitem or orders")
    epoch = f"CAST({KEYS[table]} % {P} AS INT) AS epoch"
    counted = how.upper() == "COUNT"
    value, variance = ("n_final", "n_final_var") if counted else ("v_sum", "v_sum_var")
    if counted and what.strip() != "*":
        condition = f"({condition}) AND ({what}) IS NOT NULL"
    rows = f"SELECT {epoch}{'' if counted else f', {what} AS v'} FROM {', '.join(names)} WHERE {condition}"
    plan = Plan(rows, [], [] if counted else ["v"], {"estimate": value, "half": f"{chebyshev(float(level) / 100)} * sqrt(greatest({variance}, 0))"}, table=table, variance=True)
    return Statement(plan, int(budget) / 1000, int(every or 0) / 1000)


def select_online(spark: SparkSession, sf_dir: str, text: str) -> Iterator[Report]:
    """Reports at least the given interval apart; the last one is made when the whole scan is read or
    the budget is spent. A chunk that runs is finished first; closing the generator stops earlier."""
    statement = parse(text)
    began, reported, last = time.monotonic(), None, None
    for number, fraction, df in estimates(statement.plan, spark, sf_dir):
        row = df.first()
        seconds = time.monotonic() - began
        last = Report(number, row.estimate, row.half, fraction, seconds) if row else Report(number, 0.0, None, fraction, seconds)
        if reported is None or seconds - reported >= statement.every:
            reported = seconds
            yield last
            last = None
        if seconds >= statement.seconds:
            break
    if last is not None:
        yield last
