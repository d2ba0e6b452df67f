"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. With
$BENCH_ACCURACY also errors per epoch and interval coverage."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tideline.functions.growth import growth_fit
from tideline.functions.metrics import accuracy, coverage
from tideline.functions.scaling import half_width, scale
from tideline.operators.epochs import progress
from tideline.operators.progressive import snapshots
from tideline.plans import progressive, registry
from tideline.sources import chunks
from tideline.sources.tables import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
EXACT = [*(f"tpch_q{i}" for i in range(1, 23)), *(f"ola_q{i}" for i in range(23, 28)), "deep_q30_d3", "deep_q30_d10"]
PROGRESSIVE = [n for n in progressive.QUERIES if n.startswith(("prog_", "ci_")) and not n.startswith("prog_q30")] + [f"prog_q30_d{d}" for d in (1, 2, 3)]


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def chunked(spark: SparkSession, name: str) -> list[float]:
    """Seconds until each estimate of a run over epoch-clustered files."""
    began, times = time.perf_counter(), []
    for _, _, df in progressive.estimates(progressive.PLANS[name], spark, SF_DIR):
        df.collect()
        times.append(round(time.perf_counter() - began, 3))
    return times


def prepare(spark: SparkSession) -> None:
    """The derived tables that queries share: part-supplier, and clustered copies."""
    chunks.part_supplier(spark, SF_DIR).count()
    for table in chunks.KEYS:
        chunks.epoch_rows(spark, SF_DIR, table, progressive.P)


def errors(spark: SparkSession, name: str) -> dict:
    """Error and recall of every estimate against the exact end, and the share of the scan after
    which the error stays below one percent."""
    rows = sorted(accuracy(progressive.QUERIES[name](spark, SF_DIR), progressive.PLANS[name].keys).collect(), key=lambda r: r.epoch)
    good = next((i for i in range(len(rows)) if all((r.mape or 0) < 1 for r in rows[i:])), None)
    return {"mape": [round(r.mape or 0, 3) for r in rows], "recall": [round(r.recall, 2) for r in rows], "epochs_to_1_percent": None if good is None else good + 1}


def covered(spark: SparkSession, runs: int = 20) -> list[float]:
    """Share of seeded orders of the chunks whose interval holds the exact sum, from the third epoch."""
    lines = load(spark, SF_DIR, "lineitem", ["l_orderkey", "l_quantity"])
    many = spark.range(runs).select(F.col("id").cast("int").alias("run"))
    rows = lines.crossJoin(F.broadcast(many)).withColumn("epoch", F.pmod(F.xxhash64("l_orderkey", "run"), F.lit(progressive.P)).cast("int"))
    snaps = snapshots(rows, ["run"], ["l_quantity"], progressive.P, variance=True)
    fits = None
    for run in range(runs):
        own = rows.where(F.col("run") == run)
        fit = growth_fit(snaps.where(F.col("run") == run), progress(own, progressive.P))
        out = scale(snaps.where(F.col("run") == run), fit, ["l_quantity"], variance=True).select("epoch", "l_quantity_sum", half_width(F.col("l_quantity_sum_var")).alias("half"))
        fits = out if fits is None else fits.unionByName(out)
    truth = lines.agg(F.sum("l_quantity").alias("l_quantity_sum"))
    return [round(r.covered, 3) for r in coverage(fits.where("epoch >= 2"), [], "l_quantity_sum", "half", truth).orderBy("epoch").collect()]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["tpch_q1"](spark, SF_DIR).collect()  # starts the JVM's machinery, as a long-lived session has
    prepared = timed(lambda: prepare(spark))
    seconds = {n: timed(lambda n=n: registry.QUERIES[n](spark, SF_DIR).collect()) for n in [*EXACT, *PROGRESSIVE]}
    runs = {n: chunked(spark, n) for n in ("prog_q1", "prog_q5", "prog_q6", "prog_q8", "prog_q14")}
    first = {n: {"first": t[0], "last": t[-1], "share": round(t[0] / t[-1], 3)} for n, t in runs.items()}
    more = {"accuracy": {n: errors(spark, n) for n in runs}, "ci_coverage": covered(spark, 5)} if os.environ.get("BENCH_ACCURACY") else {}
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "total seconds of all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "prepare": prepared, "chunked": first, **more, "sf": float(sf[1]) if sf else None, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
