"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and a path prefix. Every URL gives the suffixes of its host, and for
those that are listed the prefixes of its path that are as long as one of that host's entries. The
Bloom filter holds the listed hosts and entries and passes few candidates that are not listed; exact
joins remove those. All steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.storage import materialize, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BITS, BITS_PER_ENTRY = 256, 16
#: Lists of more entries or bytes are joined by shuffle: below, the filter (40 bytes a block) and the
#: entries are broadcast.
MOST_BROADCAST, MOST_BYTES = 20_000, 4 << 20
#: Between host and path in the filter's keys; a host has none.
BORDER = "/"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.lit(2147483647)))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Four words of 64 bits, two bits set in each, from a second hash of the key."""
    h = F.xxhash64(F.lit(1), key)
    bit = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, bit[2 * i]).bitwiseOR(F.call_function("shiftleft", one, bit[2 * i + 1])) for i in range(4)]


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks that are not empty: ``block`` and the words ``w0`` .. ``w3``."""
    parts = keys.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))))
    return parts.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)))


def maybe_listed(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates (column ``key``) that the filter cannot rule out."""
    hit = F.col("c.block") == F.col("b.block")
    for i, mask in enumerate(_masks(F.col("c.key"))):
        hit = hit & (F.col(f"b.w{i}").bitwiseAND(mask) == mask)
    return candidates.withColumn("block", _block(F.col("key"), blocks)).alias("c").join(bloom.alias("b"), hit, "left_semi").drop("block")


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """Judge the ``url`` of every row of ``pages`` by the list (``host, path, verdict``).

    An entry fits its host and all subdomains if the URL's path starts with its path; the longest
    entry wins. Returns ``keep`` (default ``page_id``), ``host``, ``path``, ``rule`` (host and path of
    the entry, else null) and ``verdict`` (the entry's, else ``default``). URLs that are null or
    have no ``://`` have an empty host and path and fit only an entry for that. Entries that are
    listed twice with different verdicts: the greater verdict in order wins; of entries of one length
    the one that is greater as a text. Null hosts or paths of entries count as empty; a listed path that is
    neither empty nor begins with a slash fits no URL. Repeated rows stay; other columns are ignored; an empty list gives
    ``default`` everywhere. URLs are judged once per distinct host and path, so a hot URL
    is one row; the way back is a join whose large side adaptive execution can split.
    """
    keep = ["page_id"] if keep is None else keep
    spark = pages.sparkSession
    entries = listed.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("suffix"), F.coalesce("path", F.lit("")).alias("prefix"), "verdict")
    with scratch(spark) as kept:
        entries = materialize(entries.groupBy("suffix", "prefix").agg(F.max("verdict").alias("verdict")), "url-list")
        hosts = materialize(entries.groupBy("suffix").agg(F.collect_set(F.char_length("prefix")).alias("lengths")), "url-hosts")
        n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("suffix") + F.octet_length("prefix")), F.lit(0))).first()
        near = F.broadcast if n <= MOST_BROADCAST and size <= MOST_BYTES else (lambda x: x)
        blocks = max(1, -(-(n + hosts.count()) * BITS_PER_ENTRY // BLOCK_BITS))
        full = F.concat("suffix", F.lit(BORDER), "prefix").alias("key")
        bloom = materialize(blocked_bloom(entries.select(full).union(hosts.select("suffix")), blocks), "url-bloom")
        counts = hosts.agg(F.collect_set(_labels(F.col("suffix"))).alias("counts"))  # one row

        urls = _urls(pages, keep)
        own = urls.select("host", "path").distinct().crossJoin(F.broadcast(counts))
        suffixes = F.expr(r"transform(filter(counts, n -> n <= size(split(host, '[.]'))), n -> substring_index(host, '.', -n))")
        listed_hosts = maybe_listed(own.select("host", "path", F.explode(suffixes).alias("suffix")).withColumn("key", F.col("suffix")), near(bloom), blocks).join(near(hosts), "suffix")
        prefixes = F.expr("transform(filter(lengths, n -> n <= char_length(path)), n -> substring(path, 1, n))")
        candidates = listed_hosts.select("host", "path", "suffix", F.explode(prefixes).alias("prefix")).withColumn("key", full)
        exact = maybe_listed(candidates, near(bloom), blocks).join(near(entries), ["suffix", "prefix"])
        rule = F.concat("suffix", "prefix")
        best = exact.groupBy("host", "path").agg(F.max(F.struct(F.char_length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
        best = kept(materialize(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _urls(pages: DataFrame, keep: list[str]) -> DataFrame:
    return pages.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
