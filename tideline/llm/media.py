"""Audio columns: 8-bit mono WAV bytes in, features out.

Samples are resampled by a rational factor with a polyphase windowed-sinc filter, framed with
overlap, and turned into log energies of a mel filterbank; hysteresis on the frames' energy
(open above one threshold, stay open above a lower one) gives the active segments. Features are
fixed-shape tensors, ``frames x mels``, each with its time span; ``tensor_table`` types them as
Arrow's fixed-shape tensors.

Everything is fixed-point: filters, window, transform and filterbank are tables of integers, and
all sums stay below 2**53, where float64 holds integers exactly. Features therefore do not
depend on the order in which a CPU's linear algebra adds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.batches import map_rows
from tideline.storage import materialize, scratch

#: Input and feature rates, the FFT's length, the step between frames, filters, frames a tensor.
RATE, UP, DOWN = 8000, 3, 8
FFT, STEP, MELS, FRAMES = 128, 64, 16, 32
#: Opens a segment, keeps it open: times the median frame energy of the recording.
OPEN, STAY = 1.25, 0.9
#: Steps of a logarithm to the base 2; exact as a float.
OCTAVE = 64
BLOCK = 192


def encode_wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file of 8-bit PCM samples, lossless for any bytes; odd lengths get a pad byte."""
    size = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)
    return head + payload + b"\0" * (size % 2)


def decode_wav(media: bytes) -> bytes:
    """The samples of a WAVE file's data chunk, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def lowpass(taps_per_phase: int = 4) -> np.ndarray:
    """Windowed-sinc low-pass filter in steps of 2**-12, split into UP phases of equal length."""
    n = taps_per_phase * UP * DOWN
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return np.round(h / h.sum() * UP * 4096).reshape(-1, UP).T[:, ::-1].copy()


def resample(x: np.ndarray) -> np.ndarray:
    """Whole numbers x at UP/DOWN times its rate, 64 times as large: only the outputs that are kept
    are computed."""
    phases = lowpass()
    width = phases.shape[1]
    padded = np.concatenate([np.zeros(width // 2), x, np.zeros(width)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    n = len(x) * UP // DOWN
    out = np.empty(n)
    for p in range(UP):
        k = np.arange(p, n, UP)
        phase, start = p * DOWN % UP, k * DOWN // UP
        out[p::UP] = np.floor(view[start] @ phases[phase] / 64)
    return out


@cache
def filterbank() -> np.ndarray:
    """Triangular filters evenly spaced in mel, over the FFT's bins, in steps of 2**-8."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, rate / 2, FFT // 2 + 1)
    rise = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.round(np.maximum(0, np.minimum(rise, fall)).T * 256)


@cache
def transform() -> tuple[np.ndarray, np.ndarray]:
    """The window in steps of 2**-10; cosines and sines of the transform's bins, side by side, in
    steps of 2**-12."""
    turn = 2 * np.pi * np.outer(np.arange(FFT), np.arange(FFT // 2 + 1)) / FFT
    return np.round(np.hanning(FFT) * 1024), np.round(np.hstack([np.cos(turn), np.sin(turn)]) * 4096)


@cache
def log_table() -> np.ndarray:
    """Logarithms of 1 + i/1024 to the base 2, in steps of 1/OCTAVE."""
    return np.round(np.log2(1 + np.arange(1024) / 1024) * OCTAVE)


def log_steps(x: np.ndarray) -> np.ndarray:
    """Logarithms of whole numbers from 1 to the base 2, in steps of 1/OCTAVE, by exponent and table."""
    mantissa, exponent = np.frexp(x)
    return (exponent - 1) * OCTAVE + log_table()[np.floor((2 * mantissa - 1) * 1024).astype(int)]


def mel_energies(x: np.ndarray) -> np.ndarray:
    """frames x MELS, whole numbers; the signal is padded to whole frames, so that its end is in one.
    In blocks of frames."""
    x = np.pad(x, (0, FFT - len(x) if len(x) < FFT else -(len(x) - FFT) % STEP))
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::STEP]
    window, turns = transform()
    out = np.empty((len(frames), MELS))
    for i in range(0, len(frames), 4096):
        parts = np.floor(np.floor(frames[i : i + 4096] * window / 1024) @ turns / 16384)
        power = parts[:, : FFT // 2 + 1] ** 2 + parts[:, FFT // 2 + 1 :] ** 2
        out[i : i + 4096] = power @ filterbank()
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [from, to) that open above OPEN x median and last while above STAY x median."""
    middle = float(np.median(energy)) if len(energy) else 0.0
    stay, opened = energy >= STAY * middle, energy >= OPEN * middle
    change = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True) if opened[a:b].any()]


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS) of log2 energies, the last one padded with zeros, the active frame
    spans and the tensors' spans in seconds."""
    energy = mel_energies(resample(np.frombuffer(samples, np.uint8).astype(float) - 128))
    spans = segments(np.floor(energy / 16).sum(1))
    n = -(-len(energy) // FRAMES)
    padded = np.zeros((n * FRAMES, MELS), np.float32)
    padded[: len(energy)] = log_steps(energy + 1) / OCTAVE
    second = STEP * DOWN / UP / RATE
    times = [(i * FRAMES * second, min((i + 1) * FRAMES, len(energy)) * second) for i in range(n)]
    return padded.reshape(n, FRAMES, MELS), spans, times


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (BLOCK - len(raw) if not raw else -len(raw) % BLOCK)


def text_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: the text's UTF-8 bytes, padded with spaces to a
    positive multiple of 192, as a WAVE file. Null and empty texts give one block of spaces."""

    def make():
        def work(rows):
            return [(i, n, encode_wav(p)) for i, (n, p) in ((i, payload_of(t)) for i, t in rows)]

        return work

    types = dict(docs.dtypes)
    return map_rows(docs.select("doc_id", "text"), make, [("doc_id", types["doc_id"]), ("n_bytes", "bigint"), ("media", "binary")])


def audio_features(media: DataFrame) -> DataFrame:
    """One row per tensor of every row of ``doc_id, media``: ``doc_id``, ``part``, ``from_s``,
    ``to_s``, ``active`` (share of its frames in an active segment) and ``tensor`` (FRAMES x MELS
    floats, row by row). Recordings without samples give one padded tensor; null media none."""

    def make():
        def work(rows):
            out = []
            for i, m in rows:
                if m is None:
                    continue
                tensors, spans, times = features(decode_wav(m))
                on = np.zeros(len(tensors) * FRAMES, bool)
                for a, b in spans:
                    on[a:b] = True
                share = on.reshape(-1, FRAMES).mean(1)
                out += [(i, k, *times[k], float(share[k]), tensors[k].ravel().tolist()) for k in range(len(tensors))]
            return out

        return work

    types = dict(media.dtypes)
    fields = [("doc_id", types["doc_id"]), ("part", "int"), ("from_s", "double"), ("to_s", "double"), ("active", "double"), ("tensor", "array<float>")]
    return map_rows(media.select("doc_id", "media"), make, fields)


def tensor_table(table: pa.Table) -> pa.Table:
    """The Arrow table of ``audio_features`` with ``tensor`` as a fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    at = table.schema.get_field_index("tensor")
    flat = table.column("tensor").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks]) if flat.num_chunks else pa.array([], pa.float32())
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), FRAMES * MELS))
    return table.set_column(at, pa.field("tensor", kind), column)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
PARTS = pa.schema([("part", pa.int32()), ("from_s", pa.float64()), ("to_s", pa.float64()), ("tensor", TENSOR)])


def pack_tensors(tensors: np.ndarray, times: list[tuple[float, float]]) -> bytes:
    """One recording's tensors and their spans as an Arrow stream with a fixed-shape tensor column."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel(), pa.float32()), FRAMES * MELS)
    start, end = zip(*times, strict=True)
    columns = [pa.array(range(len(times)), pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.ExtensionArray.from_storage(TENSOR, flat)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PARTS) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=PARTS))
    return sink.getvalue().to_pybytes()


def unpack_tensors(packed: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """What ``pack_tensors`` stored."""
    table = pa.ipc.open_stream(packed).read_all()
    if table.schema.field("tensor").type != TENSOR:
        raise ValueError("not a column of fixed-shape tensors")
    return table.column("tensor").combine_chunks().to_numpy_ndarray(), list(zip(table.column("from_s").to_pylist(), table.column("to_s").to_pylist(), strict=True))


DIGESTS = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string")]


def stored_tensors(media: DataFrame) -> DataFrame:
    """Per row of ``doc_id, n_bytes, media``: ``doc_id``, the digests of the WAVE file and its payload,
    ``segments`` (active frame spans) and ``tensors``, an Arrow stream of the row's fixed-shape
    tensors with their time spans."""

    def make():
        def work(rows):
            out = []
            for i, n, m in rows:
                payload = decode_wav(m)
                tensors, spans, times = features(payload)
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), [list(x) for x in spans], pack_tensors(tensors, times)))
            return out

        return work

    fields = [("doc_id", dict(media.dtypes)["doc_id"]), *DIGESTS, ("segments", "array<array<int>>"), ("tensors", "binary")]
    return map_rows(media.select("doc_id", "n_bytes", "media"), make, fields)


def feature_text(segments: list[list[int]], packed: bytes) -> str:
    """A summary of a row's stored tensors, their time spans and its segments."""
    tensors, times = unpack_tensors(packed)
    made = hashlib.sha256((tensors * OCTAVE).astype("<i2").tobytes())
    made.update(repr((times, [tuple(x) for x in segments])).encode())
    return f"{len(tensors)}x{FRAMES}x{MELS};seconds={times[-1][1]:.3f};segments={len(segments)};mean={float(tensors.astype(float).sum() / tensors.size):.3f};{made.hexdigest()[:32]}"


def media_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes`` (unpadded), and of the stored WAVE file, read
    back, ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (last 16 bytes), ``media_bytes``,
    ``media_sha256`` and ``feature``, a summary of its stored tensors, spans and segments. Equal
    texts have equal values; null and empty texts one block of spaces. The WAVE files are stored
    in the shared folder and read back, and so are the tensors made from them. No shuffle."""
    with scratch(docs.sparkSession) as keep:
        media = materialize(text_media(docs), "media-wav", "zstd")
        tensors = keep(materialize(stored_tensors(media), "media-tensors", "zstd"))

    def make():
        return lambda rows: [(*row[:-2], feature_text(*row[-2:])) for row in rows]

    return map_rows(tensors, make, [("doc_id", dict(docs.dtypes)["doc_id"]), *DIGESTS, ("feature", "string")])
