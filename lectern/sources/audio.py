"""WAV files: header scan, and cutting, joining and padding of their samples."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.paths import uint_le

HEADER = 44


def wav_headers(files: DataFrame) -> DataFrame:
    """files: path, content, length. Fields by their place in a 44-byte header; duration_ms is 0 for what is no WAV."""
    ok = (F.octet_length("content") >= HEADER) & (F.substring("content", 1, 4) == F.lit(b"RIFF")) & (F.substring("content", 9, 4) == F.lit(b"WAVE"))
    head = files.withColumn("ok", ok).withColumn("head", F.substring("content", 1, HEADER))
    c = head.select("path", "length", "ok", uint_le(F.col("head"), 22, 2).alias("channels"), uint_le(F.col("head"), 24, 4).alias("rate"), uint_le(F.col("head"), 28, 4).alias("byte_rate"), uint_le(F.col("head"), 32, 2).alias("block_align"), uint_le(F.col("head"), 34, 2).alias("bits"), uint_le(F.col("head"), 40, 4).alias("data_size"))
    ms = F.when(F.col("ok") & (F.col("byte_rate") > 0), F.floor((F.col("length") - HEADER) * 1000 / F.col("byte_rate"))).otherwise(0)
    return c.withColumn("duration_ms", ms.cast("long"))


def wav_bytes(pcm: bytes, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A 44-byte header and samples."""
    block = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * block, block, bits) + b"data" + struct.pack("<I", len(pcm)) + pcm


def _split(data: bytes) -> tuple[int, int, int, bytes]:
    channels, rate = struct.unpack("<HI", data[22:28])
    return rate, channels, struct.unpack("<H", data[34:36])[0], data[HEADER:]


def silence(ms: int, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    return bytes(rate * ms // 1000 * channels * bits // 8)


def append_silence(data: bytes, ms: int) -> bytes:
    rate, channels, bits, pcm = _split(data)
    return wav_bytes(pcm + silence(ms, rate, channels, bits), rate, channels, bits)


def merge(parts: list[bytes]) -> bytes:
    """One file from several of one format, that of the first."""
    rate, channels, bits, _ = _split(parts[0])
    return wav_bytes(b"".join(_split(p)[3] for p in parts), rate, channels, bits)


def fade(data: bytes, ms: int) -> bytes:
    """Linear fade at both ends of 16-bit samples."""
    import numpy as np

    rate, channels, bits, pcm = _split(data)
    x = np.frombuffer(pcm, "<i2").astype(float).reshape(-1, channels)
    n = min(len(x) // 2, rate * ms // 1000)
    if n:
        ramp = (np.arange(n) / n)[:, None]
        x[:n] *= ramp
        x[-n:] *= ramp[::-1]
    return wav_bytes(x.astype("<i2").tobytes(), rate, channels, bits)


def resample(data: bytes, rate: int) -> bytes:
    """Linear interpolation to another rate, 16-bit samples."""
    import numpy as np

    old, channels, bits, pcm = _split(data)
    x = np.frombuffer(pcm, "<i2").astype(float).reshape(-1, channels)
    n = len(x) * rate // old
    at = np.arange(n) * old / rate
    y = np.stack([np.interp(at, np.arange(len(x)), x[:, c]) for c in range(channels)], 1) if len(x) else x
    return wav_bytes(np.round(y).astype("<i2").tobytes(), rate, channels, bits)


def cut(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, seq, content): WAV files cut at byte offsets (path, seq, start_byte, end_byte) of their samples."""

    def run(batches):
        for b in batches:
            out = []
            for path, seq, start, end, data in zip(*(b.column(c).to_pylist() for c in ("path", "seq", "start_byte", "end_byte", "content"))):
                rate, channels, bits, pcm = _split(data)
                out.append((path, seq, wav_bytes(pcm[start:end], rate, channels, bits)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["path", "seq", "content"])

    j = files.select("path", "content").join(offsets, "path").select("path", F.col("seq").cast("long"), F.col("start_byte").cast("long"), F.col("end_byte").cast("long"), "content")
    return j.mapInArrow(run, "path string, seq long, content binary")
