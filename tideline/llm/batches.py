"""Arrow plumbing that the Python-side operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a function sees at a time. Spark closes an Arrow batch by bytes as well as by rows.
ROWS = 256


def give_back() -> None:
    """Memory that this worker's allocators hold but no longer use: idle workers stay alive for the
    next task, beside a JVM that may need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], fields: list[tuple[str, str]]) -> DataFrame:
    """Apply a function over batches of rows, as tuples, in Arrow transfer.

    ``make`` runs once per task on the executor and returns the function; that keeps models and
    caches out of the pickled closure. The function is handed at most ROWS rows at a time.
    """
    schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = work(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def extend_rows(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list], list[tuple]]], made: list[tuple[str, str]], column: str = "text") -> DataFrame:
    """The columns ``keep`` and the columns ``made`` that a function gives for the values of ``column``,
    one tuple a value. Kept columns pass as Arrow arrays and never become Python objects; those
    with the name of a made one are left out."""
    keep = [k for k in keep if k not in dict(made)]
    types = dict(df.dtypes)
    sent = [*keep, *([] if column in keep else [column])]
    names = [f"k{i}" for i in range(len(sent))]
    place = sent.index(column)
    schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in [*zip(names, [types[k] for k in keep], strict=False), *((f"m{i}", t) for i, (_, t) in enumerate(made))]))
    arrow = to_arrow_schema(schema)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = work(part.column(place).to_pylist())
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[kept:], strict=True)]
                old = [c if c.type == f.type else c.cast(f.type) for c, f in zip(part.columns[:kept], arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=arrow)
        del work
        give_back()

    done = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(sent, names, strict=True))).mapInArrow(run, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=False)), *(F.col(f"m{i}").alias(n) for i, (n, _) in enumerate(made)))


def held_out(doc_id: Any = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class TwoGenerations(dict):
    """A bounded cache for pure functions: when the young half is full it becomes the old half,
    and entries that are still in use move back on their next use."""

    def __init__(self, compute: Callable[[Any], Any], half: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.half, self.longest, self.old = compute, half, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
