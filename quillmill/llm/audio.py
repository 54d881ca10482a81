"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel frames and energy segments.

A clip is stored as a mono 8-bit PCM WAVE file in a binary column. Features come from the stored
bytes: samples are centred and resampled by ``up / down`` with a windowed-sinc filter in polyphase
form, cut into overlapping windows, and turned into log-mel energies; frames are then segmented by
hysteresis on their energy (a span opens above the upper and closes below the lower threshold, both
relative to the clip's mean level). The frames of each span are cut into windows of ``FRAMES``, and each
window is a tensor of fixed shape (``FRAMES`` by ``MELS``) with its start and end in seconds and the number
of its frames; a last window that is short repeats its last frame.

``write_features`` stores the tensors in Parquet files with Arrow's fixed-shape tensor type, beside a
file with a row for each clip, and ``read_features`` and ``read_tensors`` read these files. Files get
temporary names until the manifest that lists them is safe.

Long clips are worked on in blocks of frames, so the memory beyond the samples themselves is bounded.
Every clip is computed alone with the same shapes, so equal clips have equal features.

Defined results: null and empty texts are one block of zero bytes; a clip of constant samples has one
span over its whole length; repeated rows get equal rows each; further columns pass through, and one
with the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmill.llm import shards
from quillmill.llm.common import filesystem, releasing, slices

BLOCK = 64
RATE, UP, DOWN, TAPS = 8000, 3, 5, 12  # taps for each phase
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 16
OPEN_DB, CLOSE_DB = -6.0, -12.0
FRAMES_AT_ONCE = 4096


# ---- storage


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with zero bytes to a positive multiple of ``BLOCK``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAVE file of an even number of samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wave_samples(data: bytes) -> bytes:
    """The samples of a mono 8-bit PCM WAVE file; chunks other than format and data are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt " and struct.unpack_from("<HH", data, at + 8) + struct.unpack_from("<H", data, at + 22) != (1, 1, 8):
            raise ValueError("only mono 8-bit PCM is supported")
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


# ---- features


@lru_cache(maxsize=4)
def polyphase(up: int, down: int, taps: int) -> np.ndarray:
    """Phases of a Hann-windowed sinc low-pass, one row for each output phase, each of unit gain."""
    phase, tap = np.arange(up)[:, None], np.arange(taps)[None, :]
    away = (phase / up + taps // 2 - tap) / max(1, down / up)  # of an output from each input, in samples of the slower rate
    rows = np.sinc(away) * np.cos(np.pi / 2 * np.clip(away / (taps / 2 / max(1, down / up)), -1, 1)) ** 2
    return np.ascontiguousarray(rows / rows.sum(axis=1, keepdims=True), dtype=np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """``x`` at ``up / down`` times its rate; each output is one dot product with its phase of the filter."""
    if up == down or not len(x):
        return x.astype(np.float32)
    rows = polyphase(up, down, taps)
    n_out = -(-len(x) * up // down)
    left = taps // 2
    padded = np.concatenate([np.full(left, x[0], np.float32), x.astype(np.float32), np.full(taps + down, x[-1], np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for first_out in range(up):  # outputs first_out, first_out + up, ... advance by ``down`` inputs each
        first = first_out * down // up
        count = -(-(n_out - first_out) // up)
        if count > 0:
            out[first_out::up] = seen[first : first + (count - 1) * down + 1 : down] @ rows[first_out * down % up]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: float, window: int, mels: int) -> np.ndarray:
    """Triangular bands on the mel scale, ``window // 2 + 1`` by ``mels``."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, window // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache(maxsize=2)
def _hann(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1].astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of overlapped windows and the energy of each window in dB."""
    frames = 1 + max(0, -(-(len(y) - WINDOW) // HOP))
    y = np.concatenate([y, np.zeros((frames - 1) * HOP + WINDOW - len(y), np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    bank, hann = mel_bank(rate, WINDOW, MELS), _hann(WINDOW)
    mel, level = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, FRAMES_AT_ONCE):
        block = seen[at : at + FRAMES_AT_ONCE] * hann
        spectrum = np.fft.rfft(block)
        power = spectrum.real**2 + spectrum.imag**2
        mel[at : at + len(block)] = np.log(power @ bank + 1e-6)
        level[at : at + len(block)] = 10 * np.log10(np.einsum("ij,ij->i", block, block) / WINDOW + 1e-9)
    return mel, level


def hysteresis(level: np.ndarray, opens: float, closes: float) -> list[tuple[int, int]]:
    """Frame spans that reach ``opens`` and last while the level stays at ``closes`` or more."""
    over = np.concatenate([[False], level >= closes, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1]).reshape(-1, 2)
    if not len(edges):
        return []
    loud = np.concatenate([[0], np.cumsum(level >= opens)])
    return [(int(a), int(b)) for a, b in edges[loud[edges[:, 1]] > loud[edges[:, 0]]]]


def windows_of(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in seconds, number of frames and log-mel tensor of each window of the energy spans."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    x -= 128
    x /= 128
    y = resample(x)
    new_rate = rate * UP / DOWN
    mel, level = log_mel(y, new_rate)
    mean = float(level.mean())
    cuts = [(s, min(s + FRAMES, b)) for a, b in hysteresis(level, mean + OPEN_DB, mean + CLOSE_DB) for s in range(a, b, FRAMES)]
    if not cuts:
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros((0, FRAMES, MELS), np.float32)
    first, end = np.array(cuts, np.int64).T
    at = np.minimum(first[:, None] + np.arange(FRAMES), end[:, None] - 1)
    return first * HOP / new_rate, np.minimum(len(y), (end - 1) * HOP + WINDOW) / new_rate, (end - first).astype(np.int32), mel[at]


# ---- DataFrames


def store(df: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """``df`` with each text as a WAVE file in a binary column instead, and its length in bytes."""
    out = T.StructType([f for f in df.schema.fields if f.name not in (text, media, size)])
    keep = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = batch.column(text).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            cols = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array([wave(payload(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, size, media])

    return df.mapInArrow(run, out.add(size, T.LongType()).add(media, T.BinaryType()))


#: Half precision: log energies need no more, and the files are half as large.
TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS), dim_names=("frame", "band"))
TENSORS = pa.schema([("clip", pa.int64()), ("t0", pa.float64()), ("t1", pa.float64()), ("frames", pa.int32()), ("tensor", TENSOR)])
FACTS = T.StructType(
    [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("windows", T.LongType())]
)


def _tensor_batch(clip: int, t0: np.ndarray, t1: np.ndarray, frames: np.ndarray, tensors: np.ndarray) -> pa.RecordBatch:
    values = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel().astype(np.float16)), FRAMES * MELS)
    arrays = [pa.array(np.full(len(t0), clip)), pa.array(t0), pa.array(t1), pa.array(frames), pa.ExtensionArray.from_storage(TENSOR, values)]
    return pa.RecordBatch.from_arrays(arrays, schema=TENSORS)


def write_features(df: DataFrame, folder: str, media: str = "media") -> DataFrame:
    """Features of each clip of ``df`` in files below ``folder``; returns the manifest.

    Each task writes two files: the other columns of ``df`` with facts of the stored file and the number
    of windows, a row for each clip, and the tensors of all clips in the same order.
    """
    keep = [f.name for f in df.schema.fields if f.name != media and f.name not in FACTS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        files, clips, tensors, n, m = shards.Files(folder, ".parquet"), None, None, 0, 0
        streams = []
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            stored = batch.column(media).to_pylist()
            samples = [wave_samples(f) for f in stored]
            got = [windows_of(s) for s in samples]
            facts = [
                pa.array([len(s) for s in samples], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                pa.array([zlib.crc32(s[-BLOCK:]) for s in samples], pa.int64()),
                pa.array([len(f) for f in stored], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in stored]),
                pa.array([len(g[0]) for g in got], pa.int64()),
            ]
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *facts], names=[*keep, *FACTS.names])
            if clips is None:
                shard = TaskContext.get().partitionId()
                streams = [files.open(shard, 0), files.open(shard, 1)]
                clips, tensors = pq.ParquetWriter(streams[0], rows.schema, compression="zstd"), pq.ParquetWriter(streams[1], TENSORS, compression="zstd")
            clips.write_batch(rows)
            made = [_tensor_batch(n + k, *g) for k, g in enumerate(got) if len(g[0])]
            if made:
                tensors.write_table(pa.Table.from_batches(made))
            n, m = n + len(got), m + sum(len(g[0]) for g in got)
        if clips is None:
            return
        clips.close(), tensors.close()
        sizes = [s.tell() for s in streams]
        for s in streams:
            s.close()
        for k, (rows, size) in enumerate(zip((n, m), sizes, strict=True)):
            files.rows[k] |= {"rows": rows, "units": rows, "bytes": size}
        yield files.batch()

    return shards.commit(df.mapInArrow(lambda batches: releasing(run(batches)), shards.MANIFEST), folder)


def _open(path: str):
    import pyarrow.parquet as pq

    fs, place = filesystem(path)
    return pq.ParquetFile(fs.open_input_file(place))


def _tensors_of(path: str) -> Iterator[pa.RecordBatch]:
    """Batches of a tensor file; its type must be the one it was written with."""
    file = _open(path)
    if file.schema_arrow.field("tensor").type != TENSOR:
        raise ValueError(f"{path} holds no tensors of this shape")
    yield from file.iter_batches(batch_size=1024)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("tensor").storage.flatten().to_numpy().reshape(batch.num_rows, -1)


def read_tensors(manifest: DataFrame) -> DataFrame:
    """shard, clip (its place in the shard's file of clips), t0, t1, frames and the flat tensor of each window."""
    out = "shard int, clip long, t0 double, t1 double, frames int, tensor array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for t in _tensors_of(path):
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(_values(t).ravel().astype(np.float32)), FRAMES * MELS).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * t.num_rows, pa.int32()), *(t.column(c) for c in ("clip", "t0", "t1", "frames")), flat], names=["shard", "clip", "t0", "t1", "frames", "tensor"])

    files = manifest.where("file = 1").select("shard", "path")
    return files.repartition(max(1, files.count())).mapInArrow(run, out)


def read_features(manifest: DataFrame, columns: T.StructType) -> DataFrame:
    """Each clip's ``columns``, facts and ``feature``: the number of its windows and a digest of them, from the tensors as they were stored."""
    out = T.StructType([*columns.fields, *FACTS.fields, T.StructField("feature", T.StringType())])
    names = [f.name for f in out.fields][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                windows = _windows(path.replace("-00000.parquet", "-00001.parquet"))
                for rows in _open(path).iter_batches(batch_size=1024, columns=names):
                    found = []
                    for n in rows.column("windows").to_pylist():
                        digest, left = hashlib.sha256(), n
                        while left:
                            part = windows.send(left)
                            left -= part[0]
                            digest.update(part[1])
                        found.append(f"{n}:{digest.hexdigest()}")
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(found)], names=[*names, "feature"])

    files = manifest.where("file = 0").select("path")
    return files.repartition(max(1, files.count())).mapInArrow(lambda batches: releasing(run(batches)), out)


def _windows(path: str):
    """Answers each number of windows sent with how many it has next, at most so many, and their bytes: times to 0.1 ms, and tensors as stored."""

    def blocks():
        wanted = yield None
        for t in _tensors_of(path):
            times = np.round(np.stack([t.column("t0").to_numpy(), t.column("t1").to_numpy()], axis=1) * 1e4).astype("<i8")
            values = _values(t).astype("<f2")
            frames, at = t.column("frames").to_numpy().astype("<i4"), 0
            while at < t.num_rows:
                end = min(at + wanted, t.num_rows)
                wanted = yield end - at, b"".join(x for k in range(at, end) for x in (times[k].tobytes(), frames[k].tobytes(), values[k].tobytes()))
                at = end

    out = blocks()
    next(out)
    return out
