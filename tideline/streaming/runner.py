"""Early answers: the same estimates from a stream of chunk files, one micro-batch an epoch.

Each micro-batch is aggregated to partial results, which are merged into a stored snapshot under the
batch's number (``operators.state``); a replayed batch replaces its own. The snapshot is scaled like the
batch form's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.growth import growth_fit
from tideline.functions.scaling import scale
from tideline.operators.progressive import snapshots
from tideline.operators.state import SnapshotState
from tideline.storage import fresh_path, materialize


class ProgressiveStream:
    """Runs ``rows(chunk)`` -> keys and summed columns over files of one table, as they arrive; ``rows``
    may join tables that stand still, and ``post`` works on every estimate.

    ``total`` is the expected number of rows of the scan; every micro-batch (``maxFilesPerTrigger=1``)
    emits an estimate to ``sink(epoch, fraction, DataFrame)``. File order is modification time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, total: int, rows: Callable[[DataFrame], DataFrame], keys: list[str], sums: list[str], file_format: str = "parquet", variance: bool = False, post: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.folder, self.schema, self.rows, self.file_format, self.post = spark, folder, schema, rows, file_format, post
        self.state = SnapshotState(spark, keys, sums, total, variance)
        self.query: StreamingQuery | None = None
        self.times_ns: list[int] = []

    def _batch(self, sink: Callable[[int, float, DataFrame], None], began: int) -> Callable[[DataFrame, int], None]:
        def handle(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            try:
                self.state.add(number, self.rows(rows), rows.count())
            finally:
                rows.unpersist()
            sink(number, self.state.fraction, self.post(self.state.estimate()))
            self.times_ns.append(time.perf_counter_ns() - began)

        return handle

    def run(self, sink: Callable[[int, float, DataFrame], None]) -> list[int]:
        """Processes what is there and stops; returns the times of the estimates."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").format(self.file_format).load(self.folder)
        writer = stream.writeStream.foreachBatch(self._batch(sink, time.perf_counter_ns())).option("checkpointLocation", fresh_path(self.spark, "stream-offsets"))
        self.query = writer.trigger(availableNow=True).start()
        self.query.awaitTermination()
        return self.times_ns

    def stop(self) -> None:
        """Ends the run after the micro-batch at hand."""
        if self.query is not None:
            self.query.stop()


def run_progressive(rows: DataFrame, keys: list[str], sums: list[str], progressed: DataFrame, epochs: int) -> Iterator[tuple[int, float, DataFrame]]:
    """Generator over a replayed batch: (epoch, fraction, estimate) in order, from one stored set of
    snapshots."""
    grown = materialize(snapshots(rows, keys, sums, epochs), "replayed")
    scaled = scale(grown, growth_fit(grown, progressed), sums)
    for epoch, fraction in sorted((r.epoch, r.fraction) for r in progressed.select("epoch", "fraction").collect()):
        yield epoch, fraction, scaled.where(F.col("epoch") == epoch)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time aggregate with a watermark, for streams of events: counts and values per tumbling
    window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
