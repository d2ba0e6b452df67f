"""Where intermediate results live.

Executors and the driver share no local disk, so every table that has to outlive one job is
written below ``spark.checkpoint.dir``. Only a local session without that setting (tests, a laptop)
gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes see, from the session. A local session without the setting gets one
    of our own; on a cluster that would be another disk on every node, so it is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"{tempfile.gettempdir()}/tideline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_MADE: list[str] = []
_PREPARED: dict[tuple[str, str, str], str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used yet."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_intermediate(spark: SparkSession) -> None:
    """Delete everything this process has put into the shared folder, once results are stored."""
    _PREPARED.clear()
    while _MADE:
        drop_path(spark, _MADE.pop())


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage
    that survives lost executors (unlike a local checkpoint) and is columnar and compressed
    (unlike ``DataFrame.checkpoint``). The schema is passed along, so an empty table works."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Everything that is put into the shared folder inside is deleted at the end, but for what the
    function that is given was called with: the materialized tables that results still read."""
    first, kept = len(_MADE), []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.stored_at)
        return table

    try:
        yield keep
    finally:
        for path in [x for x in _MADE[first:] if x not in kept]:
            _MADE.remove(path)
            drop_path(spark, path)


def prepared(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """The path of a table that is derived from ``source`` once a session and then read by many queries;
    ``write`` makes it. A path that is gone meanwhile is made anew."""
    key = (shared_dir(spark), source, name)
    if key not in _PREPARED or not exists(spark, _PREPARED[key]):
        _PREPARED[key] = f"{key[0]}/prepared-{name}-{uuid.uuid4().hex}"
        _MADE.insert(0, _PREPARED[key])  # before all that a scratch block may delete
        write(_PREPARED[key])
    return _PREPARED[key]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of ours through Hadoop's file system API, whatever store it is in."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through the same API."""
    system, where = _file_system(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_single(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """One file called ``path`` from one partition of ``df``, which ``write`` puts into a folder."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    write(df.coalesce(1), folder)
    system, where = _file_system(spark, folder)
    part = next(x.getPath() for x in system.listStatus(where) if x.getPath().getName().startswith("part-"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system.delete(target, False)
    system.rename(part, target)
    system.delete(where, True)
