"""Snapshots that grow by one chunk at a time.

After every chunk the merged partial results are a stored table under the chunk's number. A chunk
that is processed again starts from the one before it and replaces its own table, so replays change
nothing. Each chunk reads the state before it once; of the whole history only a point of the
growth fit per chunk stays on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.growth import line_fit
from tideline.functions.scaling import scale
from tideline.operators.progressive import DEFAULT_COUNT, finished, merged, partials
from tideline.storage import fresh_path


class SnapshotState:
    """``total`` is the number of rows of the whole scan."""

    def __init__(self, spark: SparkSession, keys: list[str], sums: list[str], total: int, variance: bool = False, mins: list[str] = (), maxs: list[str] = ()):
        self.spark, self.keys, self.sums, self.total, self.variance, self.mins, self.maxs = spark, keys, sums, total, variance, mins, maxs
        self.folder = fresh_path(spark, "snapshot-state")
        #: By chunk: rows scanned so far, groups, and their rows.
        self.seen: dict[int, tuple[int, int, int]] = {}

    def add(self, number: int, rows: DataFrame, scanned: int) -> None:
        """Chunk ``number``, which has scanned so many rows, brings ``rows`` of keys and summed columns."""
        self.seen = {n: x for n, x in self.seen.items() if n < number}
        before = max(self.seen, default=None)
        delta = partials(rows.withColumn("epoch", F.lit(number)), self.keys, self.sums, self.mins, self.maxs, self.variance).drop("epoch")
        if before is not None:
            delta = merged(self.table(before).unionByName(delta), self.keys).where(F.col(DEFAULT_COUNT) > 0)
        delta.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.schema = delta.schema
        groups, size = self.table(number).agg(F.count(F.lit(1)), F.coalesce(F.sum(DEFAULT_COUNT), F.lit(0))).first()
        self.seen[number] = scanned + (self.seen[before][0] if before is not None else 0), groups, size

    def table(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{number}")

    @property
    def fraction(self) -> float:
        """Of the scan, after the last chunk."""
        return min(1.0, self.seen[max(self.seen)][0] / self.total) if self.total else 1.0

    def snapshot(self) -> DataFrame:
        """The last snapshot, unscaled, with its ``epoch``."""
        number = max(self.seen)
        return finished(self.table(number), self.sums, self.variance).withColumn("epoch", F.lit(number))

    def estimate(self) -> DataFrame:
        """The last snapshot, scaled to the end of the scan."""
        points = [(math.log(min(1.0, scanned / self.total)), math.log(size / groups)) for scanned, groups, size in self.seen.values() if groups]
        power, spread = line_fit(points)
        fit = self.spark.createDataFrame([(max(self.seen), self.fraction, power, spread)], "epoch int, fraction double, power double, slope_var double")
        return scale(self.snapshot(), fit, self.sums, variance=self.variance)
