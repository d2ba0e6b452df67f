"""``python -m tideline.cli QUERY [SF_DIR] [OUT_DIR] [latency|accuracy]``. Progressive queries run chunk by
chunk; ``meta.json`` has the time of every estimate."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from tideline.plans import registry
from tideline.plans.progressive import PLANS, estimates
from tideline.sources.tables import write_csv_file, write_epochs, write_estimates, write_timing
from tideline.storage import drop_intermediate


def main() -> None:
    parser = argparse.ArgumentParser(prog="tideline", description="Run one query and write its result as CSV.")
    parser.add_argument("query", choices=sorted(registry.QUERIES))
    parser.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    parser.add_argument("out_dir", nargs="?", default="out")
    parser.add_argument("experiment", nargs="?", choices=["latency", "accuracy"], default="latency")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"tideline {args.query}").getOrCreate()
    began = time.perf_counter_ns()
    if args.query in PLANS:
        times = write_estimates(estimates(PLANS[args.query], spark, args.sf_dir), args.out_dir, args.experiment)
    else:
        df = registry.QUERIES[args.query](spark, args.sf_dir)
        if "epoch" in df.columns:
            write_epochs(df, args.out_dir, args.experiment)
        else:
            write_csv_file(df, f"{args.out_dir}/final.csv")
        times = [time.perf_counter_ns() - began]
    write_timing(spark, f"{args.out_dir}/meta.json", args.out_dir, times)
    drop_intermediate(spark)


if __name__ == "__main__":
    main()
