"""Media columns: sound in WAV bytes, and fingerprints of its spectrum.

``encode`` stores a payload of bytes losslessly as 8-bit samples of a WAV file
in a binary column; ``fingerprint`` reads such a column back with the wave
module, takes short-time Fourier transforms, picks the spectral peaks of each
frame, at most one a band, and pairs each peak with the next frames' peaks. A pair
is stored as one number under the time of its first peak, in time order. A peak
is greater than its neighbours and stands above the median of its frame, so
silence has none and noise has few.

Defined cases: a null or empty text is a payload of 64 zero bytes; repeated
rows and doc_ids are encoded row by row, equal texts to equal bytes; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.llm import scan

RATE = 8000
HOP = 64
FRAME = 128

#: Frequency bands in which each frame has one peak.
BANDS = ((1, 12), (12, 65))

#: Times the median of its frame that a peak has at least.
ABOVE = 2.5

#: A peak is paired with those of so many frames after it.
REACH = 2


def payload(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(HOP, -(-len(raw) // HOP) * HOP) - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(rate)
        sound.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = scan.text_array(batch.column(1))
        for at in range(0, len(raw), 1000):
            part = raw.slice(at, 1000).to_pylist()
            columns = [batch.column(0).slice(at, 1000), pa.array([len(x) for x in part], pa.int64()), pa.array([to_wav(payload(x)) for x in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, and its sound in column media."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def peaks(blocks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The peak of each band in each frame, 0 for none, one row a block of HOP samples.

    A frame is a block and the one after it; a sound's last block stands with silence."""
    signal = blocks.astype(np.float32) - 128
    after = np.empty_like(signal)
    after[:-1] = signal[1:]
    after[ends - 1] = 0
    power = np.abs(np.fft.rfft(np.concatenate([signal, after], 1) * _WINDOW, axis=1))
    least = ABOVE * np.median(power[:, 1:], axis=1)
    frame, out = np.arange(len(power)), []
    for a, b in BANDS:
        at = power[:, a:b].argmax(1) + a
        here = power[frame, at]
        beside = np.maximum(power[frame, at - 1], power[frame, np.minimum(at + 1, power.shape[1] - 1)])
        above = (here > least) & (here > 1e-3) & ((here > beside) | ((at == power.shape[1] - 1) & (here >= beside)))
        out.append(np.where(above, at, 0))
    return np.stack(out, 1)


def pairs(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of each sound, and their bounds.

    A pair is time << 20 | first frequency << 13 | second << 6 | distance."""
    n = len(found)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    time = np.arange(n) - start
    parts, where = [], []
    for distance in range(1, REACH + 1):
        at = np.flatnonzero(left > distance)
        for a in range(len(BANDS)):
            for b in range(len(BANDS)):
                both = at[(found[at, a] > 0) & (found[at + distance, b] > 0)]
                parts.append(time[both] << 20 | found[both, a] << 13 | found[both + distance, b] << 6 | distance)
                where.append(both)
    codes, where = np.concatenate(parts), np.concatenate(where)
    order = np.argsort(where, kind="stable")
    return codes[order], np.searchsorted(where[order], bounds)


def _groups(sounds: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sounds):
        end, size = at + 1, len(sounds[at])
        while end < len(sounds) and size + len(sounds[end]) <= scan.BLOCK:
            size += len(sounds[end])
            end += 1
        yield at, end
        at = end


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"]
    for batch in batches:
        media = batch.column(2).to_pylist()
        for first, last in _groups(media):
            part = media[first:last]
            sounds = [from_wav(m) for m in part]
            samples = np.frombuffer(b"".join(sounds), np.uint8).reshape(-1, HOP)
            bounds = np.cumsum([0, *(len(s) // HOP for s in sounds)])
            codes, cuts = pairs(peaks(samples, bounds[1:]), bounds)
            columns = [
                batch.column(0).slice(first, last - first),
                batch.column(1).slice(first, last - first),
                pa.array([len(s) for s in sounds], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in sounds]),
                pa.array([zlib.crc32(s[-HOP:]) for s in sounds], pa.int64()),
                pa.array([len(m) for m in part], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in part]),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def fingerprint(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: lengths, checksums and the fingerprint array."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_fingerprinted, schema)


def feature(column: str = "fingerprint") -> Column:
    """A short text for a fingerprint: its length and a hash of all its pairs."""
    return F.concat_ws(":", F.size(column).cast("string"), F.hex(F.xxhash64(column)))
