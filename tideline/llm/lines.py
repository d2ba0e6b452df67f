"""Line dedup over levelled sorted runs of line hashes.

The state is a set of runs: bucketed tables of hashes, sorted within their buckets, none of which
occurs in two runs. A batch of documents is merge-joined with the runs on the buckets the runs
already have (no run is shuffled again): keys that some run has are known, the others become a
new run of level 0. When a level has ``fanout`` runs they are compacted into one of the next.
Keys are pairs of 64-bit hashes of the normalised line. Built-in expressions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.storage import drop_path, fresh_path, materialize, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]
LAST_ID = (1 << 63) - 1
#: Bytes of hashes in a bucket of a run that has all keys.
BUCKET_BYTES = 32 << 20


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The runs, by level. Tables are external ones in the shared folder, with their buckets in the
    session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = [[]]

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys`` with a column ``known``: whether a run has the key."""
        for i, (name, _) in enumerate(self.runs()):
            keys = keys.join(self.spark.table(name).select(*KEY, F.lit(True).alias(f"in{i}")).hint("merge"), KEY, "left")
        flags = [F.col(f"in{i}") for i in range(len(self.runs()))]
        return keys.withColumn("known", F.coalesce(*flags, F.lit(False))).drop(*(f"in{i}" for i in range(len(flags))))

    def add(self, keys: DataFrame) -> None:
        """A new run of keys that no run has; compacts full levels."""
        self.levels[0].append(self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(name) for name, _ in full]))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self._drop(full)
            level += 1

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        rows = keys.select(*KEY).repartition(self.buckets, *KEY)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, buckets: int | None = None) -> DataFrame:
    """Places of the lines to drop: ``id``, ``text_hash``, ``drops`` (array of places from 0).

    Documents are taken in ``batches`` ranges of their ids, the smallest ids first, so that the
    first document to bring a key is the one that keeps it.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text")
    bounds = own.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    batch = reduce(lambda a, b: a + b, [(F.col("id") > b).cast("int") for b in bounds], F.lit(0))
    lines = own.select(batch.alias("batch"), "id", F.xxhash64("text").alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("batch", "id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    with scratch(spark) as keep:
        place = fresh_path(spark, "lines")
        lines.write.partitionBy("batch").parquet(place)
        lines = spark.read.schema("id long, text_hash long, place int, h1 long, h2 long, batch int").parquet(place)
        # buckets by bytes, at least one a core: every bucket of every run is a file
        buckets = buckets or max(spark.sparkContext.defaultParallelism, 16 * lines.count() // BUCKET_BYTES)
        runs, verdicts = LineRuns(spark, buckets, fanout), []
        try:
            for b in range(len(bounds) + 1):
                keys = lines.where(F.col("batch") == b).groupBy(*KEY).agg(F.min("id").alias("low"), F.max("id").alias("high"))
                seen = materialize(runs.known(keys), "line-keys")
                if b < len(bounds):
                    runs.add(seen.where(~F.col("known")))
                twice = seen.where(F.col("known") | (F.col("low") < F.col("high")))
                verdicts.append(twice.select(F.lit(b).alias("batch"), *KEY, F.when(~F.col("known"), F.col("low")).alias("keeper")))
        finally:
            runs.close()
        ruled = reduce(DataFrame.unionByName, verdicts)
        dropped = lines.join(ruled, ["batch", *KEY]).where(F.col("keeper").isNull() | (F.col("id") != F.col("keeper")))
        return keep(materialize(dropped.groupBy("id", "text_hash").agg(F.collect_set("place").alias("drops")), "line-drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, buckets: int | None = None) -> DataFrame:
    """Remove repeated lines from the whole ``text`` of every row.

    Texts are split at ``\\n``; null and empty texts are one empty line. Keys (``line_key``) of at
    least ``min_chars`` code points that occur in two or more documents lose all their lines
    except in the document with the smallest ``doc_id``. A null id counts as the largest id; rows
    with equal ids are one document. Returns all columns of ``docs`` and ``kept_text``, ``n_lines``
    (before) and ``n_dropped``; columns of these names are replaced, other names never clash.
    Null texts have the empty ``kept_text``. Very frequent lines are aggregated before the shuffle
    and their rows joined in a way that adaptive execution can split.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, fanout, buckets)
    drops = drops.select(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash"), F.col("drops").alias("__drops"))
    whole = docs.drop("kept_text", "n_lines", "n_dropped").withColumns({"__id": F.coalesce("doc_id", F.lit(LAST_ID)), "__text_hash": F.xxhash64("text")})
    both = whole.join(drops, ["__id", "__text_hash"], "left")
    lines = text_lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.when(F.col("__drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda p: F.get("__lines", p)), "\n"))
    both = both.withColumn("__lines", lines).withColumns({"kept_text": kept, "n_lines": F.size("__lines").cast("bigint"), "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("bigint")})
    return both.drop("__id", "__text_hash", "__drops", "__lines")
