"""Media columns: text payloads as 8-bit audio, and features of the audio.

store() puts each payload into a binary column as a mono 8-bit WAV file, lossless; read_back() parses it again.
features() resamples by a polyphase filter, takes overlapped log-mel frames, and finds active spans by energy with
hysteresis. with_tensors() keeps each file's fixed-shape (PATCH_FRAMES x MELS) Arrow tensors with their time spans in a
binary column, as an Arrow stream; read_back() stores them, reads them again, and takes the features from them. patches()
gives them as rows, which tensors() turns into Arrow fixed-shape tensors again.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal values, whatever the batch;
an empty table gives an empty table; extra input columns are ignored. Samples are handled in blocks of BLOCK, so memory
follows the block and the longest document's bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import stored, table

RATE = 16_000
UP, DOWN, TAPS = 1, 2, 16
FRAME, HOP, MELS = 256, 128, 32
PATCH_FRAMES = 64
#: Around the file's mean energy.
ENTER_DB, LEAVE_DB = 0.5, -0.5
BLOCK = 1 << 20
UNIT = 64
#: Files whose tensors are in memory at once.
PART = 256


def payload(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples(media: bytes) -> memoryview:
    """The data chunk of a file that wav() made, or of any 8-bit mono PCM file."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind = 12, None
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if kind is None or (kind[0], kind[1], kind[5]) != (1, 1, 8):
                raise ValueError(f"not 8-bit mono PCM: {kind}")
            return view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc low-pass as up rows, one for each phase, of taps weights."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1] * up
    return h.reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Output m is the sum over k of h[phase, k] * x[m * down // up - k], phase = m * down % up; only wanted outputs are made."""
    h = _filter(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(down, np.float32)])
    y = np.zeros(n, np.float32)
    for first in range(up):  # outputs first, first + up, ... share a phase, and their bases lie down apart
        base, phase = divmod(first * down, up)
        count = len(range(first, n, up))
        part = np.zeros(count, np.float32)
        for k in range(taps):
            at = base + taps - 1 - k
            part += h[phase, k] * padded[at : at + (count - 1) * down + 1 : down]
        y[first::up] = part
    return y


@lru_cache
def _mel(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale 2595 log10(1 + f / 700), as a (bins x mels) matrix."""
    hz = np.linspace(0, rate / 2, frame // 2 + 1)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), mels + 2) / 2595) - 1)
    up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(audio: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (frames x MELS) log-mel values and of the frames' energies in dB; frames overlap by FRAME - HOP.

    The last frame is filled with zeros, and there is one frame at least.
    """
    raw, rest, out_rate = np.frombuffer(audio, np.uint8), np.zeros(0, np.float32), RATE * UP // DOWN
    history = np.zeros(0, np.float32)
    step = BLOCK // (UP * DOWN) * UP * DOWN
    for at in range(0, max(len(raw), 1), step):
        x = (raw[at : at + step].astype(np.float32) - 128) / 128
        lead = len(history)  # a multiple of DOWN, so phases stay
        y = resample(np.concatenate([history, x]))[lead * UP // DOWN :]
        history = x[-(-(-TAPS // DOWN) * DOWN) :]
        rest = np.concatenate([rest, y])
        last = at + step >= len(raw)
        if last:
            short = -(len(rest) - FRAME) % HOP if len(rest) > FRAME else FRAME - len(rest)
            rest = np.concatenate([rest, np.zeros(short, np.float32)])
        n = (len(rest) - FRAME) // HOP + 1
        if n < 1:
            continue
        frames = np.lib.stride_tricks.sliding_window_view(rest[: (n - 1) * HOP + FRAME], FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        energy = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + np.float32(1e-10))
        yield np.log(power.astype(np.float32) @ _mel(out_rate, FRAME, MELS) + np.float32(1e-6)), energy
        rest = rest[n * HOP :]


def active(energy: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> np.ndarray:
    """Spans (first, past the last) of frames: one begins at enter or more and lasts until energy falls below leave."""
    mark = np.where(energy >= enter, 1, np.where(energy < leave, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], np.where(at >= 0, mark[at] > 0, False), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return edges.reshape(-1, 2)


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames of a file and its active spans."""
    blocks = list(log_mel(samples(media)))
    mel, energy = (np.concatenate(x) for x in zip(*blocks, strict=True))
    return mel, active(energy - energy.mean(dtype=np.float64))


def feature_text(mel: np.ndarray, spans: np.ndarray) -> str:
    """Counts of frames and spans, the active frames, and each band's mean in quarters of a neper."""
    quarters = np.round(mel.mean(axis=0, dtype=np.float64) * 4).astype(int)
    return f"frames={len(mel)};spans={len(spans)};active={int((spans[:, 1] - spans[:, 0]).sum())};mel={','.join(map(str, quarters))}"


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and the media column."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in values], pa.int64()), pa.array([wav(payload(x)) for x in values], pa.binary())], ["key", "n_bytes", "media"])

    return df.select(F.col(key).alias("key"), F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


def patch_batch(media: bytes) -> pa.RecordBatch:
    """Of a file, a row for each PATCH_FRAMES frames: its span in seconds, whether it holds an active frame, starts and ends of
    the active spans cut to it, and the fixed-shape tensor, the last filled with zeros."""
    mel, spans = features(media)
    n = -(-len(mel) // PATCH_FRAMES)
    full = np.zeros((n * PATCH_FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * PATCH_FRAMES
    last = np.minimum(first + PATCH_FRAMES, len(mel))
    within: list[list[float]] = [[] for _ in range(n)]
    for begin, end in spans.tolist():
        for k in range(begin // PATCH_FRAMES, (end - 1) // PATCH_FRAMES + 1):
            within[k] += [seconds(max(begin, int(first[k]))), seconds(min(end, int(last[k])))]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), PATCH_FRAMES * MELS)
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (PATCH_FRAMES, MELS)), flat)
    columns = [pa.array(range(n), pa.int32()), pa.array(seconds(first)), pa.array(seconds(last)), pa.array([bool(x) for x in within]), pa.array(within, pa.list_(pa.float64())), tensor]
    return pa.RecordBatch.from_arrays(columns, ["patch", "start_s", "end_s", "active", "spans", "tensor"])


def packed(batch: pa.RecordBatch) -> bytes:
    """An Arrow stream of one batch."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and active spans from the tensors of a stream that packed() made."""
    (batch,) = pa.ipc.open_stream(stream)
    frame = lambda s: np.rint(np.asarray(s, np.float64) / seconds(1)).astype(np.int64)
    mel = batch["tensor"].to_numpy_ndarray().reshape(-1, MELS)[: int(frame(batch["end_s"].to_numpy()[-1]))]
    spans: list[list[int]] = []
    for begin, end in frame(batch["spans"].flatten().to_numpy()).reshape(-1, 2).tolist():
        if spans and spans[-1][1] == begin:  # one span that two patches share
            spans[-1][1] = end
        else:
            spans.append([begin, end])
    return mel, np.array(spans, np.int64).reshape(-1, 2)


def with_tensors(media: DataFrame) -> DataFrame:
    """Digests from the stored bytes, and each file's patch_batch() as an Arrow stream."""
    kind = media.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PART):
                b = whole.slice(first, PART)
                out: list[tuple] = []
                for i in range(b.num_rows):
                    stored_bytes = b.column(2)[i].as_py()
                    data = samples(stored_bytes)
                    out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), packed(patch_batch(stored_bytes))))
                cols = zip(*out, strict=True)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"])

    return media.mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests from the stored bytes alone, and features from the tensors, which are stored too and read again."""
    kept = stored(with_tensors(media), "tensors")
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [feature_text(*unpacked(x.as_py())) for x in b.column(7)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(found, pa.string())], [*b.schema.names[:7], "feature"])

    return kept.mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def patches(media: DataFrame) -> DataFrame:
    """A row for each row of a file's patch_batch(), without the active spans, its tensor flat."""
    kind = media.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = patch_batch(b.column(2)[i].as_py())
                keys = pa.array([b.column(0)[i].as_py()] * found.num_rows, b.schema.field(0).type)
                flat = found["tensor"].storage.cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([keys, *found.columns[:4], flat], ["key", "patch", "start_s", "end_s", "active", "tensor"])

    return media.mapInArrow(run, f"key {kind}, patch int, start_s double, end_s double, active boolean, tensor array<float>")


def tensors(rows: pa.Table) -> pa.Table:
    """rows of patches() with the tensor column as an Arrow fixed-shape tensor."""
    shape = (PATCH_FRAMES, MELS)
    flat = rows["tensor"].combine_chunks()
    fixed = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), shape[0] * shape[1])
    at = rows.schema.get_field_index("tensor")
    return rows.set_column(at, "tensor", pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), fixed))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(store(table(spark, sf_dir, "documents")), "media")
    return read_back(kept).withColumnRenamed("key", "doc_id")
