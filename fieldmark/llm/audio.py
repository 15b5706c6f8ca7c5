"""Audio features of media columns.

A document's bytes are the samples of an 8-bit mono WAV file. The file's bytes are read back,
resampled by a polyphase filter bank, framed with overlap into log-mel energies and cut into
segments by an energy threshold with hysteresis. Log-mel frames are stored as tensors of one fixed
shape (CHUNK x MELS, the last one padded with the floor value), each with its time span.

One pass, no shuffle: every row is worked on by itself, resampled in slices of SLICE samples that hand
the filter's history on, so memory is bounded by one row's bytes.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import table, whole_text

UNIT, RATE = 192, 16_000
UP, DOWN, TAPS = 2, 3, 8
FRAME, HOP, MELS, CHUNK = 256, 128, 24, 64
ENTER_DB, LEAVE_DB = 1.5, 0.5
FLOOR = 1e-6
SLICE = 3 << 18  # a multiple of DOWN, so that a slice begins at phase 0
TENSORS = 256  # that are held before a batch is handed on


def bank() -> np.ndarray:
    """Polyphase parts of a windowed-sinc low-pass filter: row p holds taps p, p+UP, p+2*UP, ..."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * cut * np.hamming(TAPS * UP)
    return (UP * h / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray, parts: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """x at UP/DOWN of its rate: output n is phase n*DOWN mod UP of the bank over the samples before n*DOWN/UP.
    before: the TAPS-1 samples that x follows (zeros at the beginning)."""
    total = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32) if before is None else before, x, np.zeros(1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(total, np.float32)
    for first in range(UP):
        phase, at = first * DOWN % UP, first * DOWN // UP
        count = len(range(first, total, UP))
        out[first::UP] = windows[at::DOWN][:count] @ parts[phase][::-1]
    return out


def resampled(samples: np.ndarray, parts: np.ndarray, size: int = SLICE) -> np.ndarray:
    """resample() of all samples, `size` (a multiple of DOWN) at a time."""
    old = np.concatenate([np.zeros(TAPS - 1, np.float32), samples])
    return np.concatenate([resample(samples[i : i + size], parts, old[i : i + TAPS - 1]) for i in range(0, len(samples), size)])


def mel_bank() -> np.ndarray:
    """Triangles over FRAME/2+1 bins, evenly spaced on the mel scale."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


class Features:
    def __init__(self):
        self.parts, self.mels, self.window = bank(), mel_bank(), np.hanning(FRAME).astype(np.float32)

    def frames(self, samples: np.ndarray):
        """Log-mel energies [frames, MELS] and frame energies in dB."""
        x = resampled(samples, self.parts)
        if len(x) < FRAME:
            x = np.pad(x, (0, FRAME - len(x)))
        views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        mel, db = [], []
        for i in range(0, len(views), SLICE // FRAME):
            power = np.abs(np.fft.rfft(views[i : i + SLICE // FRAME] * self.window, axis=1)).astype(np.float32) ** 2
            mel.append(np.log(power @ self.mels + FLOOR))
            db.append(10 * np.log10(power.sum(axis=1) + FLOOR))
        return np.concatenate(mel), np.concatenate(db)


def segments(db: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that reach ENTER_DB above the median and last while they stay LEAVE_DB above it."""
    mid = np.median(db)
    low = np.concatenate([[False], db >= mid + LEAVE_DB, [False]])
    edges = np.flatnonzero(np.diff(low.astype(np.int8)))
    high = np.concatenate([[0], np.cumsum(db >= mid + ENTER_DB)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if high[b] > high[a]]


def wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


SECONDS = HOP * DOWN / UP / RATE
SHAPE = "n_bytes long, n_frames long, media binary, segments array<struct<start_s:double,end_s:double>>, tensors array<struct<start_s:double,end_s:double,log_mel:array<float>>>"


def _spans(rows: list[list[tuple[float, float]]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Offsets, starts and ends of each row's spans."""
    flat = np.array([x for r in rows for x in r], float).reshape(-1, 2)
    return pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat[:, 0]), pa.array(flat[:, 1])


def audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_frames, media (WAV bytes), segments (time spans), and tensors: log-mel frames of CHUNK*MELS
    floats each, with their time spans (`tensor_column` gives them Arrow's fixed-shape type).

    Null text counts as empty and becomes UNIT blanks; empty tables give empty results; repeated
    rows are worked on each by itself and a null doc_id is kept. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        ids, sizes, frames, media, cuts, tensors = zip(*done)
        at, first, last = _spans(cuts)
        segments = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([first, last], ["start_s", "end_s"]))
        at, first, last = _spans([[(c * CHUNK * SECONDS, min((c + 1) * CHUNK, n) * SECONDS) for c in range(len(t) // CHUNK)] for n, t in zip(frames, tensors)])
        flat = np.concatenate(tensors).ravel()
        mels = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, CHUNK * MELS), pa.int32()), pa.array(flat))
        chunks = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([first, last, mels], ["start_s", "end_s", "log_mel"]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(frames, pa.int64()), pa.array(media, pa.binary()), segments, chunks], names=["doc_id", "n_bytes", "n_frames", "media", "segments", "tensors"])

    def work(batches):
        f, done, held = Features(), [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column("text")[at].as_py().encode()
                media = wav(text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text)))
                mel, db = f.frames((np.frombuffer(samples_of(media), np.uint8).astype(np.float32) - 128) / 128)
                tensor = np.full((-(-len(mel) // CHUNK) * CHUNK, MELS), np.log(FLOOR), np.float32)
                tensor[: len(mel)] = mel
                done.append((batch.column("doc_id").slice(at, 1), len(text), len(mel), media, [(a * SECONDS, b * SECONDS) for a, b in segments(db)], tensor))
                held += len(tensor) // CHUNK
                if held >= TENSORS:
                    yield packed(done)
                    done, held = [], 0
        if done:
            yield packed(done)

    return rows.mapInArrow(work, f"doc_id {kind}, {SHAPE}")


def tensor_column(table: pa.Table) -> pa.ExtensionArray:
    """The tensors of a collected batch (column log_mel) as Arrow's fixed-shape tensor array."""
    flat = pa.concat_arrays([c.flatten() for c in table.column("log_mel").chunks])
    kind = pa.fixed_shape_tensor(pa.float32(), (CHUNK, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, CHUNK * MELS))


HEADER = 44  # bytes of a WAV file before its samples


def op1_audio(spark, sf_dir: str) -> DataFrame:
    """Digests of the stored media, tensors and spans: feature is a hash of all tensors, their time spans and the segments' spans."""
    payload = F.substring("media", HEADER + 1, 1 << 30)
    size = F.octet_length("media") - HEADER
    hashed = F.lpad(F.lower(F.hex(F.xxhash64("tensors", "segments"))), 16, "0")
    feature = F.concat_ws(";", hashed, F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("tensors="), F.size("tensors")), F.concat(F.lit("segments="), F.size("segments")))
    return audio(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring("media", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "n_frames", F.size("segments").cast("long").alias("n_segments"))
