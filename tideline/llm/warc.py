"""WARC archives and the normaliser of monolithic gzip files.

Crawlers may write a whole archive as one gzip stream, which cannot be entered in the middle.
The normaliser inflates such a stream once, from its start, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets; any record is then one seek away.
Files go to the shared folder through Arrow's file systems. A task's files have names of their
own, so a task that runs twice leaves an orphan and never a half-written archive in use.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.batches import map_rows
from tideline.storage import drop_path, fresh_path, materialize, scratch

#: An archive is closed at this many bytes of payload or records.
MOST_BYTES, MOST_RECORDS = 32 << 20, 20_000
#: Tasks that normalise and read archives, each one archive or more.
MOST_TASKS = 20_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + END


def response_record(page: str, url: str | None, payload: bytes) -> bytes:
    clean = "".join(c for c in (url or "") if c > " ")
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, page)}>", "WARC-Date": DATE, "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Page-Id": page, "Content-Type": "application/http; msgtype=response"}
    return record_bytes(headers, HTTP + payload)


def revisit_of(headers: dict[str, str], payload_bytes: int, refers_to: str) -> bytes:
    """The record as a revisit of a page: its payload is that page's and is not repeated."""
    kept = {k: v for k, v in headers.items() if k not in ("WARC-Type", "Content-Length")}
    more = {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, refers_to)}>", "X-Refers-To-Page": refers_to, "X-Payload-Length": str(payload_bytes)}
    return record_bytes({"WARC-Type": "revisit"} | kept | more, HTTP)


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed chunks of a gzip file, of one member or several."""
    engine = zlib.decompressobj(31)
    while chunk := stream.read(1 << 20):
        while chunk:
            yield engine.decompress(chunk)
            chunk = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC stream; holds one record at a time."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        at, seen = -1, 0
        while at < 0:
            at = buffer.find(END, max(0, seen - 3))
            seen = len(buffer)
            if at < 0 and not fill(seen + 1):
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        lines = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        if not fill(at + 4 + size + 4):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(buffer[at + 4 : at + 4 + size])
        del buffer[: at + 4 + size + 4]


def normalize_stream(source: BinaryIO, target: BinaryIO, rewrite: Callable[[int, dict[str, str], bytes], bytes] | None = None) -> list[dict]:
    """Inflate ``source`` once and write every record to ``target`` as its own member. ``rewrite``
    may give another record for one (from its place, headers and block). Returns the index."""
    index, offset = [], 0
    for i, (headers, block) in enumerate(records(inflate(source))):
        plain = {k: v for k, v in headers.items() if k != "Content-Length"}
        raw = rewrite(i, plain, block) if rewrite else record_bytes(plain, block)
        engine = zlib.compressobj(5, zlib.DEFLATED, 31)
        member = engine.compress(raw) + engine.flush()
        target.write(member)
        index.append({"id": headers.get("WARC-Record-ID", ""), "offset": offset, "length": len(member)})
        offset += len(member)
    return index


def read_member(file: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    file.seek(offset)
    return next(records(inflate(pa.BufferReader(file.read(length)))))


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one response record per row of ``pages`` (``page_id, url, html``) into archives that
    are one gzip stream each. Returns ``archive``, ``place``, ``page_id``, ``payload_bytes`` and
    ``payload_digest`` of the records; evaluate it once (``materialize``)."""
    schema = T.StructType.fromDDL("archive string, place int, page_id long, payload_bytes long, payload_digest string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        rows: list[tuple] = []
        out = engine = None
        size, path = 0, ""

        def finish() -> list[pa.RecordBatch]:
            nonlocal out, rows
            if out is None:
                return []
            out.write(engine.flush())
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            out, rows = None, []
            return [done]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if out is None:
                        path, size, engine = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{path}", compression=None)
                    payload = (html or "").encode("utf-8")
                    out.write(engine.compress(response_record("" if page is None else str(page), url, payload)))
                    rows.append((path, len(rows), page, len(payload), payload_digest(payload)))
                    size += len(payload)
                    if size >= MOST_BYTES or len(rows) >= MOST_RECORDS:
                        yield from finish()
        yield from finish()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


def classify(written: DataFrame) -> DataFrame:
    """``written`` with ``refers_to`` and ``is_response``: of records with equal payloads that with
    the largest page_id (null counts as smallest; of equal ids one) is the response."""
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("o"), "archive", "place", "page_id")
    groups = written.groupBy("payload_digest", "payload_bytes").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups.where("copies > 1"), "warc-groups")
    both = written.join(groups, ["payload_digest", "payload_bytes"], "left")
    first = F.col("top").isNull() | ((F.col("archive") == F.col("top.archive")) & (F.col("place") == F.col("top.place")))
    return both.select("archive", "place", "payload_bytes", first.alias("is_response"), F.when(~first, F.coalesce(F.col("top.page_id").cast("string"), F.lit(""))).alias("refers_to"))


def normalize_archives(judged: DataFrame, source: str, target: str, tasks: int) -> DataFrame:
    """Normalise every archive of ``judged`` (``classify``) from folder ``source`` to ``target``,
    with revisit records where it says so, and a sidecar index beside each. One group is one
    archive, of bounded size. Its rows are few bytes and stand for megabytes, so the number of
    tasks is set here and not left to the size of the shuffle. Returns ``archive``, ``index`` and
    ``records``."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        (store, base), (put, there) = open_store(source), open_store(target)
        name = group["archive"].iloc[0]
        revisits = {int(p): (int(n), r) for p, n, r in zip(group["place"], group["payload_bytes"], group["refers_to"], strict=True) if isinstance(r, str)}

        def rewrite(i: int, headers: dict[str, str], block: bytes) -> bytes:
            return revisit_of(headers, *revisits[i]) if i in revisits else record_bytes(headers, block)

        put.create_dir(there, recursive=True)
        path = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        with store.open_input_stream(f"{base}/{name}", compression=None) as src, put.open_output_stream(f"{there}/{path}", compression=None) as out:
            index = normalize_stream(src, out, rewrite)
        if len(index) != len(group):
            raise ValueError(f"{name} has {len(index)} records, not {len(group)}")
        with put.open_output_stream(f"{there}/{path}.idx", compression=None) as out:
            out.write("".join(json.dumps(x) + "\n" for x in index).encode())
        return pd.DataFrame({"archive": [path], "index": [f"{path}.idx"], "records": [len(index)]})

    return judged.repartition(tasks, "archive").groupBy("archive").applyInPandas(work, "archive string, index string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives, entered through their sidecar indexes:
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. A response's
    figures are those of the payload that is read; a revisit's are in its headers."""

    def make():
        store, base = open_store(folder)

        def work(rows):
            out = []
            for name, index in rows:
                with store.open_input_stream(f"{base}/{index}", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                with store.open_input_file(f"{base}/{name}") as f:
                    for e in entries:
                        headers, block = read_member(f, e["offset"], e["length"])
                        page = headers["X-Page-Id"]
                        if headers["WARC-Type"] == "revisit":
                            n, digest, to = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["X-Refers-To-Page"]
                        else:
                            payload, to = block[block.index(END) + 4 :], ""
                            n, digest = len(payload), payload_digest(payload)
                        out.append((int(page) if page else None, n, digest, headers["WARC-Type"], int(to) if to else None))
            return out

        return work

    return map_rows(archives.select("archive", "index"), make, [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as monolithic archives, normalise them with revisit
    records for equal payloads, and read the result back.

    Returns one row per page: ``page_id``, ``payload_bytes``, ``payload_digest`` (base32 SHA-1),
    ``record_type`` and ``refers_to`` (the response's page; null for responses). Null html is an
    empty payload; empty payloads are equal payloads too. Repeated rows are records of their own,
    one of them the response. Other columns are ignored. The payloads are never shuffled: only
    digests and verdicts are, and the join that spreads a hot digest can be split. The archives stay in
    ``folder``; without one only the normalised members do.
    """
    spark = pages.sparkSession
    place = folder or fresh_path(spark, "warc")
    with scratch(spark) as keep:
        written = materialize(write_archives(pages, f"{place}/raw"), "warc-written")
        tasks = max(1, min(written.select("archive").distinct().count(), MOST_TASKS))
        done = keep(materialize(normalize_archives(classify(written), f"{place}/raw", f"{place}/members", tasks), "warc-done"))
        if folder is None:  # nobody asked for the monolithic archives
            drop_path(spark, f"{place}/raw")
    return read_archives(done.repartition(tasks), f"{place}/members")
