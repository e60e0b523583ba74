"""Vectorised scans of whole Arrow batches of texts.

A batch of strings is one byte buffer with offsets, so words, lines, hashes and
n-grams of all its documents come from a few numpy passes, without a loop over
documents. Buffers are cut into groups of whole documents of about
``BLOCK`` bytes, which bounds the memory of the temporary arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19

#: Bytes of rows that are taken from a batch at once, about.
SLICE = 1 << 21

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near inputs look unrelated."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * _MULTIPLIER)


def _powers(size: int, seed: int, down: bool) -> np.ndarray:
    """Powers of an odd base, or of its inverse, modulo 2**64."""
    base = (0xD1342543DE82EF95 + 2 * 0x5851F42D4C957F2D * seed) % 2**64 | 1
    b = pow(base, -1, 2**64) if down else base
    p = np.ones(size, np.uint64)
    n = 1
    with np.errstate(over="ignore"):
        while n < size:
            m = min(n, size - n)
            p[n : n + m] = p[:m] * np.uint64(pow(b, n, 2**64))
            n += m
    return p


_kept_powers = lru_cache(maxsize=8)(_powers)


def powers(size: int, seed: int, down: bool = False) -> np.ndarray:
    """At least size powers; those of a block are kept, more are made anew, as a worker
    would hold them through all that follows."""
    room = BLOCK + 1024
    return _kept_powers(room, seed, down) if size <= room else _powers(size, seed, down)


def prefix_hash(values: np.ndarray, seed: int) -> np.ndarray:
    """prefix[i]: hash of values[:i]; differences give the hash of any run."""
    up = powers(len(values) + 1, seed)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run [start, end), the same wherever the run stands."""
    down = powers(len(prefix), seed, down=True)
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def byte_values(data: np.ndarray, seed: int) -> np.ndarray:
    return _byte_table(seed)[data]


def text_array(column: pa.Array) -> pa.Array:
    """Any Arrow string column as large binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "").cast(pa.large_binary())


@dataclass
class Texts:
    """Whole documents first .. first + n of a batch: their bytes and bounds."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def blocks(column: pa.Array, limit: int = 0) -> Iterator[Texts]:
    """Groups of whole documents; a longer document is a group of its own."""
    limit = limit or BLOCK
    array = text_array(column)
    n = len(array)
    if not n:
        return
    _, offset_buffer, value_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(value_buffer, np.uint8) if value_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield Texts(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a block: byte bounds, and the word range of each document."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: Texts) -> Words:
    inside = ~SPACE[texts.data]
    n = len(inside)
    edge = texts.bounds[texts.bounds < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


def word_hashes(texts: Texts, found: Words, seed: int = 0, lower: bool = False) -> np.ndarray:
    data = texts.data
    if lower:
        data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5))
    return run_hash(prefix_hash(byte_values(data, seed), seed), found.starts, found.ends, seed)


def windows(bounds: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` items that lie within one document."""
    total = int(bounds[-1])
    room = np.zeros(total + 1, np.int64)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - size + 1, bounds[:-1])
    np.add.at(room, lo, 1)
    np.add.at(room, hi, -1)
    return np.flatnonzero(np.cumsum(room[:total]) > 0)


def covered(starts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in one of the runs."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:total]) > 0


def slices(batches: Iterable[pa.RecordBatch], limit: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a few at a time: a batch has as many rows as the session says,
    however long they are, and what a task makes of them at once, and sends, is then small."""
    for batch in batches:
        step = max(1, batch.num_rows * (limit or SLICE) // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def giving_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, after which memory that is free goes back to the system: a worker lives on
    through the stages that follow, and keeps what its allocators hold."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
