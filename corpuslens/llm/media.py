"""Media columns: payloads as WAV audio, short-time spectra, and spectral-peak pair fingerprints.

``encode_wav`` stores bytes losslessly as 8-bit mono samples in a WAV container (standard ``wave`` module).
``wav_features`` reads such a column back and takes, for each frame of a short-time Fourier transform, the
strongest bins; each peak is paired with the next peaks within a few frames, and the pair (both bins, the
distance in frames) is a hash with the frame of its first peak as time code: two parallel arrays a row.
``feature`` is a sketch of the hashes (their smallest mixed values), equal for equal payloads.

``media_columns`` does both with a stored table between: what is read back is what was written.

Null text counts as empty. Payloads are padded with bytes 255 to a positive multiple of ``unit``. A column
value that is no WAV file raises. Repeated rows give equal values; an empty table gives an empty result.
Both steps run in their scans' tasks: no shuffle. A very long text is one value; its spectra are taken in blocks.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, stored

FRAME, HOP, PEAKS, FAN, REACH, SKETCH = 128, 64, 2, 4, 12, 8
BLOCK = 4096


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the strongest local maxima of each frame, in time order. Silence has none."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if len(samples) >= FRAME else np.zeros((0, FRAME), np.uint8)
    window, times, bins = np.hanning(FRAME), [], []
    for at in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft((frames[at : at + BLOCK].astype(np.float64) - 128.0) * window, axis=1))
        inner = power[:, 1:-1]
        height = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), np.round(inner, 3), 0.0)
        best = np.argsort(-height, axis=1, kind="stable")[:, :PEAKS]
        best.sort(axis=1)
        t = np.repeat(np.arange(at, at + len(best)), PEAKS)
        b = best.ravel()
        loud = np.take_along_axis(height, best, axis=1).ravel() > 1.0
        times.append(t[loud])
        bins.append(b[loud] + 1)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *times]), np.concatenate([empty, *bins])


def pair_hashes(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs: each peak with the next FAN ones at most REACH frames later."""
    codes, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k in range(1, FAN + 1):
        gap = times[k:] - times[:-k]
        near = gap <= REACH
        codes.append(times[:-k][near].astype(np.int32))
        hashes.append((bins[:-k][near] << 11 | bins[k:][near] << 4 | gap[near]).astype(np.int32))
    code, value = np.concatenate(codes), np.concatenate(hashes)
    order = np.lexsort((value, code))
    return code[order], value[order]


def sketch(hashes: np.ndarray) -> str:
    mixed = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.unique((mixed ^ mixed >> np.uint64(29)) >> np.uint64(32))[:SKETCH]
    return "".join(f"{int(v):08x}" for v in low) or "silence"


def encode_wav(docs: DataFrame, unit: int = 576) -> DataFrame:
    """doc_id, n_bytes (of the text, before padding) and media, the text's bytes as a WAV file."""

    def run(batches):
        drop_held()
        for batch in small_batches(batches, 256):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            media = [to_wav(d.ljust(max(1, -(-len(d) // unit)) * unit, b"\xff")) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def wav_features(media: DataFrame) -> DataFrame:
    """Digests of media and payload as read back, the time-coded fingerprint (two arrays) and its sketch."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "hashes"]

    def run(batches):
        drop_held()
        for batch in small_batches(batches, 256):
            rows = []
            for doc_id, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                payload = from_wav(stored)
                code, value = pair_hashes(*spectral_peaks(np.frombuffer(payload, np.uint8)))
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), sketch(value), code, value))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, hashes array<int>")


def media_columns(docs: DataFrame, unit: int = 576) -> DataFrame:
    """The features of docs' media column, which is written as a table and read back."""
    return wav_features(stored(encode_wav(docs, unit), "media"))
