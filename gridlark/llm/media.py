"""Media columns: payloads as WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

``encode_wav`` adds a column of whole WAV files (mono, 8 bit, made and read by the wave module), ``fingerprint``
reads such a column back. A fingerprint is an array of (time, code): spectral peaks are the strongest local maxima over the bins of a frame
of the STFT magnitude, above the mean of the frame; each peak is paired with the next ones within a span of
frames, and a pair's code packs both bins and the distance, stored at the first peak's frame.

Every document is handled by itself inside its batch: nothing is shuffled, and memory is bounded by the longest
document. Null and empty texts hold one frame of padding. Extra input columns are kept by neither function but
the key; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import arrow_map, buffers, prepare

BLOCK = 576
RATE = 8000
PAD = 255
PEAKS_A_FRAME = 3
FAN = 3
SPAN = 8


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def stft(payload: bytes, frames: int = 4096) -> Iterator[np.ndarray]:
    """Magnitudes of Hann-windowed frames of 576 samples, half overlapping, some thousand frames at a time."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    hop = BLOCK // 2
    all_frames = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::hop]
    window = np.hanning(BLOCK).astype(np.float32)
    for i in range(0, len(all_frames), frames):
        yield np.abs(np.fft.rfft(all_frames[i : i + frames] * window, axis=1)).astype(np.float32)


def peaks(magnitude: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest bins of each frame that no neighbour in bin exceeds, above the frame's mean."""
    m = magnitude[:, 1:-1]
    top = (m >= magnitude[:, :-2]) & (m > magnitude[:, 2:]) & (m > magnitude.mean(axis=1, keepdims=True))
    kept = np.where(top, m, -1)
    if kept.shape[1] > PEAKS_A_FRAME:
        best = np.argpartition(-kept, PEAKS_A_FRAME, axis=1)[:, :PEAKS_A_FRAME]
    else:
        best = np.tile(np.arange(kept.shape[1]), (len(kept), 1))
    frame = np.repeat(np.arange(len(m)), best.shape[1])
    best = best.ravel()
    real = kept[frame, best] > 0
    frame, best = frame[real], best[real] + 1
    order = np.lexsort((best, frame))
    return frame[order], best[order]


def pairs(frame: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each peak with its next FAN peaks in later frames at most SPAN away."""
    times, codes = [], []
    later = np.searchsorted(frame, frame, "right")
    for k in range(FAN):
        j = later + k
        i = np.flatnonzero(j < len(frame))
        j = j[i]
        gap = frame[j] - frame[i]
        near = gap <= SPAN
        i, j, gap = i[near], j[near], gap[near]
        times.append(frame[i])
        codes.append((bins[i] << 20) | (bins[j] << 8) | gap)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def landmarks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    frames, bins, base = [], [], 0
    for m in stft(payload):
        f, b = peaks(m)
        frames.append(f + base)
        bins.append(b)
        base += len(m)
    return pairs(np.concatenate(frames), np.concatenate(bins))


def encode_wav(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each whole text, padded with bytes 255 to a positive multiple of 576, as a WAV file."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            for s in range(0, batch.num_rows, 256):
                e = min(s + 256, batch.num_rows)
                media, sizes = [], []
                for i in range(s, e):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    sizes.append(len(raw))
                    media.append(to_wav(raw + bytes([PAD]) * ((-len(raw)) % BLOCK if raw else BLOCK)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return arrow_map(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def fingerprint(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload facts, and the fingerprint as two parallel arrays: times and codes."""
    kind = dict(media.dtypes)[key]
    out = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, times array<int>, codes array<int>"

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                rows = []
                for wav in part.column(2):
                    wav = wav.as_py()
                    payload = from_wav(wav)
                    time, code = landmarks(payload)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), 2 * len(payload) // BLOCK - 1, time, code))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in out.split(", ")])

    return arrow_map(media.select(F.col(key).alias("key"), "n_bytes", "media"), run, out).withColumnRenamed("key", key)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fingerprint(encode_wav(docs))
    code = F.sha2(F.concat_ws(",", F.col("times").cast("array<string>"), F.col("codes").cast("array<string>")), 256)
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("codes").cast("string"), code)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "times", "codes")


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES: dict[str, str] = {}
