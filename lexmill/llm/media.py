"""Media columns: WAV files read by the wave module, short-time Fourier transforms, spectral-peak fingerprints.

A text is carried as 8-bit mono samples of a WAV file. Reading the file back gives the payload, from
whose frames a short-time Fourier transform picks the loudest bins; pairs of peaks that lie close in
time become codes (first bin, second bin, frames between), stored as time-coded arrays.

Null and empty texts are a payload of one block of spaces. Texts of any length are whole: samples go
through the transform in slabs. Repeated rows give repeated results, an empty table an empty one, and
only the two named columns are read. Equal texts have equal values in every column.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000
FRAME = 192
HOP = 96
BANDS = ((1, 9), (9, 25), (25, 97))
REACH = 2
SLAB = 4096


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((1, 1, rate, len(samples), "NONE", "not compressed"))
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return file.readframes(file.getnframes())


_window = np.hanning(FRAME)


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every frame the loudest bin of each band, the lowest of equals, and the power there, as whole numbers."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, powers = [], []
    for at in range(0, len(frames), SLAB):
        slab = (frames[at : at + SLAB].astype(np.float64) - 128) * _window
        spectrum = np.fft.rfft(slab, axis=1)
        power = np.rint(spectrum.real**2 + spectrum.imag**2)
        best = [power[:, lo:hi].argmax(1) + lo for lo, hi in BANDS]
        bins.append(np.stack(best, 1))
        powers.append(np.stack([power[np.arange(len(slab)), b] for b in best], 1))
    return np.concatenate(bins), np.concatenate(powers)


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (in frames) and codes of the peak pairs.

    A peak counts if it is at least as loud as the mean of its band. It pairs with the counted peaks of
    the next ``REACH`` frames; code = first bin * 2**16 + second bin * 2**8 + frames between.
    """
    bins, power = spectral_peaks(samples)
    loud = power >= power.mean(0)
    times, codes = [], []
    for gap in range(1, REACH + 1):
        for a in range(len(BANDS)):
            for b in range(len(BANDS)):
                at = np.flatnonzero(loud[:-gap, a] & loud[gap:, b])
                times.append(at)
                codes.append((bins[at, a] << 16) | (bins[at + gap, b] << 8) | gap)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_media: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per document: sizes and digests of text, payload and stored WAV, and the fingerprint.

    The fingerprint is the time-coded arrays ``times`` and ``codes``; ``feature`` is "peak pairs:SHA-256 of times
    and codes". with_media adds the WAV bytes (``media``). A narrow pass, no shuffle.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = to_wav(raw + b" " * (-len(raw) % block if raw else block))
                payload = from_wav(media)
                time, code = peak_pairs(np.frombuffer(payload, np.uint8))
                mark = hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
                row = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(code)}:{mark}"]
                rows.append([*row, time, code, *[media] * with_media])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * with_media]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes", *["media"] * with_media]
    chosen = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    schema = f"`{id_column}` {chosen.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    return chosen.mapInArrow(convert, schema + ", media binary" * with_media)
