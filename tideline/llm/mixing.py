"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size times on average. The whole part is
certain; the fraction is rounded dependently: pairs of documents exchange word mass at random
until one of them is whole, so that the mass of a group stays what it was and at most one document
per group is left with a fraction. Those residuals meet in a tree of groups of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.storage import materialize, scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MOST = 3


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source_key`` (orders as the source's code points, null last), ``size`` and
    ``times``, how many rows are alike in these; combined on the map side."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select("doc_id", key.alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"))
    return rows.groupBy("doc_id", "source_key", "size").agg(F.count(F.lit(1)).alias("times"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source_key``, ``docs``, ``source_size``, ``target``.

    Sources in order have the weights in turn and share the total of all sizes; a target stops at
    MOST times its source's size and the excess is shared again by weight. The result is
    ``min(MOST * size, level * weight)``; the level is found by aggregations over the table of
    sources, which may be large: they are ranked by a range sort with offsets per partition.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("times").alias("docs"), F.sum(F.col("size") * F.col("times")).alias("source_size"))
    ordered = materialize(sources.orderBy("source_key").withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    parts = ordered.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    offsets, before = [], 0
    for part, n in parts:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    if not offsets:
        return ordered.select("source_key", "docs", "source_size", F.lit(0.0).alias("target"))
    rank = F.element_at(F.create_map(*offsets), F.shiftright("place", 33)) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    total = ranked.agg(F.sum("source_size")).first()[0]
    level = 0.0
    while True:  # the level rises until no further source is capped
        full = F.lit(float(MOST)) * F.col("source_size") <= F.lit(level) * F.col("weight")
        capped, free = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if not free or (new := (total - MOST * capped) / free) <= level:
            break
        level = new
    target = F.least(F.lit(float(MOST)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return ranked.select("source_key", "docs", "source_size", target.alias("target"))


def scatter(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two hashes; the same in every run."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivotal(weight: list[int], share: list[float], mark: list[int], seed: int = 0) -> list[float]:
    """Shares after rounding: each is 0 or 1 but at most one. Items meet in the given order; the
    weighted sum of the shares is kept, and so is each share's expectation."""
    share = list(share)
    left = -1
    for i in range(len(share)):
        if not weight[i] or share[i] <= 1e-12 or share[i] >= 1 - 1e-12:
            share[i] = float(round(share[i])) if weight[i] else 0.0
            continue
        if left < 0:
            left = i
            continue
        mass_a, mass_b = weight[left] * share[left], weight[i] * share[i]
        up, down = min(weight[left] - mass_a, mass_b), min(mass_a, weight[i] - mass_b)
        if scatter(mark[left], mark[i], seed) * (up + down) < down:
            mass_a, mass_b = mass_a + up, mass_b - up
        else:
            mass_a, mass_b = mass_a - down, mass_b + down
        share[left], share[i] = mass_a / weight[left], mass_b / weight[i]
        whole = [s <= 1e-9 or s >= 1 - 1e-9 for s in (share[left], share[i])]
        share[left], share[i] = (float(round(s)) if w else s for s, w in zip((share[left], share[i]), whole, strict=True))
        left = i if whole[0] and not whole[1] else left if not whole[0] else -1
    return share


def occurrences(group: pd.DataFrame) -> pd.DataFrame:
    """A row for each of the rows that ``times`` stands for, each with a mark of its own."""
    place = np.repeat(np.arange(len(group)), group["times"])
    first = np.cumsum(group["times"]) - group["times"]
    number = np.arange(len(place)) - first.to_numpy()[place]
    out = group.iloc[place].reset_index(drop=True)
    return out.assign(times=np.int64(1), mark=(out["mark"].to_numpy().view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))


def round_groups(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: ``pivotal`` in every group of ``source_key, bucket``, the largest
    documents first, so that what is left over is small. In the last level a remaining fraction
    is rounded by chance."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = occurrences(group).sort_values(["size", "mark", "no_id", "id"], ascending=[False, True, True, True], kind="stable")
        share = pivotal(group["size"].tolist(), group["share"].tolist(), group["mark"].tolist(), seed)
        if last:
            share = [s if s in (0.0, 1.0) else float(scatter(m, 1, seed) < s) for s, m in zip(share, group["mark"].tolist(), strict=True)]
        return group.assign(share=np.array(share, float))

    return rows.groupBy("source_key", "bucket").applyInPandas(work, rows.schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), leaf: int = 2048, fan_in: int = 256, seed: int = 20) -> DataFrame:
    """Choose how often every row of ``docs`` (``doc_id, source, text``) is taken.

    Returns ``doc_id``, ``size`` (words), ``source_size``, ``target`` (words its source should give),
    ``copies`` and ``taken`` (``copies * size``). Texts without words, and null ones, have size 0 and no copy; a null
    source is a source of its own, the last. Each source's taken words differ from the target by
    less than one of its documents. The choice depends on ids, sizes and ``seed`` only, never on
    how the rows are partitioned; repeated rows are taken each on its own. A source of any size is
    dealt over groups of about ``leaf`` rows by a hash of the id; rows that are alike are counted
    first and travel in lots of ``leaf / 8``, so that one id on many rows is no group of its own. Null
    ids are ids like others.
    """
    spark = docs.sparkSession
    lot = max(1, leaf // 8)
    with scratch(spark) as keep:
        rows = materialize(sized(docs), "mix-sizes")
        targets = materialize(source_targets(rows, weights), "mix-targets")
        n_sources = targets.count()
        near = F.broadcast if n_sources <= 50_000 else (lambda x: x)
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        rows = rows.join(near(targets), "source_key").withColumn("ratio", F.least(ratio, F.lit(float(MOST))))
        rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / lot))))
        mark = F.xxhash64("doc_id", "size", "lot", F.lit(seed))
        rows = rows.select(
            F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "source_key", "size", "source_size", "target",
            F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("share"), mark.alias("mark"),
            F.pmod(F.xxhash64(mark, F.lit(1)), F.ceil(F.col("docs") / leaf).cast("bigint")).alias("bucket"),
            F.least(F.lit(lot).cast("bigint"), F.col("times") - F.col("lot") * lot).alias("times"),
        )
        most = targets.agg(F.max("docs")).first()[0] or 0
        levels = 1 + max(0, math.ceil(math.log(max(1, -(-most // leaf)), fan_in)))
        done = []
        for level in range(levels):
            last = level == levels - 1
            rows = keep(materialize(round_groups(rows, seed + level, last), f"mix-level{level}"))
            fraction = (F.col("share") > 0) & (F.col("share") < 1)
            done.append(rows.where(~fraction))
            rows = rows.where(fraction).withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("bigint"))
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("share").cast("int")).otherwise(F.lit(0))
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))
