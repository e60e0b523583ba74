"""Token ids on disk as one wavelet matrix a shard.

A wavelet matrix keeps one bit-plane for each bit of an id, highest first; after
each plane the ids are parted by that bit, zeros before ones, keeping order.
With counts of ones at every 512th bit it answers, from the file alone, which id
stands at a place, how often an id occurs before a place, and where its k-th
occurrence is. Shards hold documents in ascending doc_id order.

Defined cases: a null or empty text is its end id alone; null doc_ids come
first; rows with equal doc_ids stand next to each other in the order of a hash
of their texts; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.llm import tokens

END_ID = 2

#: Ids in a shard at most, unless one document has more.
SHARD = 1 << 21

#: Bits between two stored counts of ones.
STEP = 512

_MAGIC = b"WVM1"
_SCHEMA = "shard long, n_tokens long, doc_ids array<long>, lengths array<long>, planes binary"


class WaveletMatrix:
    def __init__(self, size: int, zeros: list[int], planes: np.ndarray, counts: np.ndarray):
        self.size, self.zeros, self.planes, self.counts = size, zeros, planes, counts
        self.bits = len(zeros)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int = 0) -> WaveletMatrix:
        bits = bits or max(int(ids.max(initial=0)).bit_length(), 1)
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        n = len(rest)
        width = -(-max(n, 1) // STEP) * STEP // 8
        planes = np.zeros((bits, width), np.uint8)
        zeros = []
        for level in range(bits):
            one = (rest >> rest.dtype.type(bits - 1 - level)) & rest.dtype.type(1) != 0
            packed = np.packbits(one, bitorder="little")
            planes[level, : len(packed)] = packed
            zero = ~one
            low = rest[zero]
            zeros.append(len(low))
            rest = np.concatenate([low, rest[one]])
        return cls(n, zeros, planes, cls._counts(planes))

    @staticmethod
    def _counts(planes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(planes).reshape(len(planes), -1, STEP // 8).sum(2, dtype=np.uint32)
        out = np.zeros((len(planes), ones.shape[1] + 1), np.uint32)
        np.cumsum(ones, axis=1, out=out[:, 1:])
        return out

    def to_bytes(self) -> bytes:
        """Header, zeros of each plane, counts, planes; all little-endian."""
        head = _MAGIC + struct.pack("<QI", self.size, self.bits) + struct.pack(f"<{self.bits}Q", *self.zeros)
        return head + self.counts.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        size, bits = struct.unpack_from("<QI", raw, 4)
        zeros = list(struct.unpack_from(f"<{bits}Q", raw, 16))
        at = 16 + 8 * bits
        steps = -(-max(size, 1) // STEP)
        counts = np.frombuffer(raw, "<u4", bits * (steps + 1), at).reshape(bits, steps + 1)
        planes = np.frombuffer(raw, np.uint8, bits * steps * STEP // 8, at + counts.nbytes).reshape(bits, -1)
        return cls(size, zeros, planes, counts)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        step = i // STEP
        a, b = step * STEP // 8, i >> 3
        n = int(self.counts[level, step]) + int(np.bitwise_count(self.planes[level, a:b]).sum())
        return n + (int(self.planes[level, b]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def rank(self, token: int, i: int) -> int:
        """How often a token stands before place i."""
        if token >> self.bits:
            return 0
        low, high = 0, min(i, self.size)
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0; -1 if there is none."""
        if k < 0 or k >= self.rank(token, self.size):
            return -1
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            if self.rank(token, middle + 1) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        out = np.zeros(self.size, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            before = np.empty_like(out)
            z = self.zeros[level]
            before[~one] = out[:z]
            before[one] = out[z:] | np.uint32(1 << (self.bits - 1 - level))
            out = before
        return out


def _builder(end_id: int, path: str, shard_size: int):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end = np.array([end_id], np.uint32)
        bits = int(max(encoder.full.get_vocab_size() - 1, end_id)).bit_length()
        number = TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        size = 0

        def shard() -> pa.RecordBatch:
            blob = WaveletMatrix.of(np.concatenate(held), bits).to_bytes()
            columns = [pa.array([number]), pa.array([size]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "n_tokens", "doc_ids", "lengths", "planes"])

        for batch in batches:
            ids_of = encoder.encode(pc.fill_null(batch.column(1), "").to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of):
                if held and size + len(ids) + 1 > shard_size:
                    yield shard()
                    number += 1
                    held, doc_ids, lengths, size = [], [], [], 0
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                size += len(ids) + 1
        if held:
            yield shard()

    return built


def write(docs: DataFrame, folder: str, end_id: int = END_ID, path: str = "", shard_size: int = SHARD) -> None:
    """Write the shards of docs, one a row of the files in folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shards = ordered.mapInArrow(_builder(end_id, path or tokens.default_path(), shard_size), _SCHEMA)
    shards.write.option("compression", "zstd").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard, size, doc_ids, lengths = (batch.column(k)[i].as_py() for k in range(4))
            ids = WaveletMatrix.from_bytes(batch.column(4)[i].as_py()).decode()
            if len(ids) != size:
                raise ValueError("a shard's planes and its length disagree")
            bounds = np.append(0, np.cumsum(lengths))
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [pa.array([shard] * len(crc), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "place", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the shards: its place among all ids, its length and checksum."""
    shards = spark.read.schema(_SCHEMA).parquet(folder)
    base = shards.select("shard", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = shards.mapInArrow(_documents, "shard long, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard")
