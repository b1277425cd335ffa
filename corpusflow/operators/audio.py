"""Audio as bytes: lengths, kinds, places, and the few kernels that need arrays."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructType

from corpusflow.functions.reading import outer_trimmed

# First bytes of encoded audio; columns that may hold audio as bytes, and as a path, in order of preference.
MAGIC = {"wav": "RIFF", "flac": "fLaC", "ogg": "OggS", "mp3": "ID3"}
BYTE_COLUMNS = ("bytes", "audio_bytes", "wav_bytes")
PATH_COLUMNS = ("path", "audio_path", "file", "filepath", "wav", "wav_path", "original_audio_path")


def pcm_seconds(audio: Column, rate: Column) -> Column:
    """Length of 16-bit mono audio in seconds; no audio is 0."""
    return F.coalesce(F.octet_length(audio) / F.lit(2) / rate, F.lit(0.0))


def encoding_of(audio: Column) -> Column:
    """wav, flac, ogg or mp3 by the first bytes, else ``pcm``; null stays null."""
    out = F.when(audio.isNull(), F.lit(None).cast("string"))
    for kind, magic in MAGIC.items():
        out = out.when(F.substring(audio, 1, len(magic)) == F.lit(magic.encode()), F.lit(kind))
    return out.otherwise(F.lit("pcm"))


def located(df: DataFrame) -> Column:
    """Where a row's audio is, as the name of the place; null where it is nowhere.

    A struct ``audio`` is looked through for array, bytes and path, a binary one is taken
    as it is; then come the byte columns and the path columns that ``df`` has. Columns of
    another type than bytes and text hold no audio.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = F.when(F.lit(False), F.lit(""))
    audio = kinds.get("audio")
    if isinstance(audio, StructType):
        inner = {f.name: f.dataType for f in audio.fields}
        for part in ("array", "bytes", "path"):
            if part in inner:
                there = F.col(f"audio.{part}") != "" if isinstance(inner[part], StringType) else F.col(f"audio.{part}").isNotNull()
                out = out.when(there, F.lit(f"audio.{part}"))
    elif isinstance(audio, BinaryType):
        out = out.when(F.col("audio").isNotNull(), F.lit("audio"))
    for name in BYTE_COLUMNS:
        if isinstance(kinds.get(name), BinaryType):
            out = out.when(F.col(name).isNotNull(), F.lit(name))
    for name in PATH_COLUMNS:
        if isinstance(kinds.get(name), StringType):
            out = out.when(outer_trimmed(F.col(name)) != "", F.lit(name))
    return out


@F.arrow_udf(DoubleType())
def pcm_energy(audio: pa.Array) -> pa.Array:
    """Mean square of 16-bit samples as fractions of full scale; an odd last byte is left out."""
    out = []
    for data in audio.to_pylist():
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float64) / 32768.0 if data else np.array([])
        out.append(float(np.mean(x * x)) if len(x) else None)
    return pa.array(out, pa.float64())


def decoded(data: bytes, rate: int = 16000) -> tuple[np.ndarray, int]:
    """Audio bytes as samples in -1..1, mono, and their rate: a WAV file by its header, other bytes as 16-bit mono of ``rate``.

    A WAV file must hold 16-bit samples; kinds that need a decoder raise an error.
    """
    if data.startswith(MAGIC["wav"].encode()):
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                raise ValueError("only 16-bit WAV files are read")
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            return x.mean(axis=1).astype(np.float32) / np.float32(32768), w.getframerate()
    if data.startswith(tuple(m.encode() for m in MAGIC.values())):
        raise ValueError("this kind of audio needs a decoder")
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / np.float32(32768), rate


def mono_pcm(samples: np.ndarray) -> bytes:
    """Samples as 16-bit mono bytes.

    Two dimensions are channels and frames, channels first where there are at most eight
    and fewer than frames; of more dimensions the last is the channels. Whole numbers are
    scaled by the largest magnitude of their type; other samples are held to -1..1.
    """
    x = np.asarray(samples)
    scale = 1.0
    if np.issubdtype(x.dtype, np.integer):
        scale = float(max(abs(np.iinfo(x.dtype).min), np.iinfo(x.dtype).max))
    if not x.size:
        return b""
    if x.ndim > 1:
        channels_first = x.ndim == 2 and x.shape[0] <= 8 and x.shape[0] < x.shape[1]
        x = x.mean(axis=0) if channels_first else x.reshape(-1, x.shape[-1]).mean(axis=1 if x.ndim == 2 else 0)
        scale = 1.0  # a mean is no whole number any more
    return np.round(np.clip(x.astype(np.float32) / scale, -1.0, 1.0) * 32767.0).astype("<i2").tobytes()
