"""Which places of a corpus hold something that another place holds, too.

Shared by the two operators that remove repeated passages. Rows say that a hash
stands at a place (key, pos): key names a document, pos a position in it. What
one batch of documents already shows to repeat is settled there, and one row a
hash and batch tells the other batches. So however common a passage is, a hash
is never shuffled more than once a batch, and no task holds a group of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import scan

#: Not known to repeat; known to; known to, and of no use to other places.
UNKNOWN, KNOWN, SETTLED = 0, 1, 2

#: ``at`` packs pos, a number n below 2 ** 14 and the state.
SCHEMA = "g long, g2 long, key long, at long"
NAMES = ["g", "g2", "key", "at"]

#: What is dealt out: rows of one range of hashes, column by column, in one value.
DEALT = "part int, n int, rows binary"

#: Hashes keep their first 48 bits here; those that decide anything come in pairs.
SHORT = np.uint64(16)
BITS = 48

#: Ranges of hashes for each shuffle partition; one range is in memory at a time, and
#: each batch makes a row for each range.
RANGES = 2


def pos_of(at: Column | np.ndarray) -> Column | np.ndarray:
    return F.shiftright(at, 16) if isinstance(at, Column) else at >> 16


def n_of(at: np.ndarray) -> np.ndarray:
    return (at >> 2) & 0x3FFF


def state_of(at: Column | np.ndarray) -> Column | np.ndarray:
    return at.bitwiseAND(F.lit(3)) if isinstance(at, Column) else at & 3


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether no doc_id is null or comes twice, so that it can stand for its row."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    odd = counts.where("doc_id is null or n > 1")
    return odd.isEmpty()


def keyed(docs: DataFrame, by_id: bool = False) -> DataFrame:
    """key, doc_id and text. The key is a hash of both, so rows equal in both count as
    one document, or the doc_id itself, which takes less room, if by_id says it can."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(0)) if by_id else F.xxhash64("doc_id", "text")
    return rows.select(key.alias("key"), "doc_id", "text")


def first_rows(key: np.ndarray) -> np.ndarray:
    """Which rows of a batch have a key that no earlier row of it has."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def parts_of(spark: SparkSession) -> int:
    return RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bytes(columns: list[np.ndarray], first: int, last: int) -> bytes:
    """Rows first to last: of each column all first bytes, then all second ones, and so
    on, which the shuffle's compression makes short."""
    return b"".join(c[first:last].view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _columns(raw: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(4, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes]


def scatter(g: np.ndarray, g2: np.ndarray, key: np.ndarray, pos: np.ndarray, n: np.ndarray, state: np.ndarray, parts: int) -> pa.RecordBatch:
    """The rows of a batch by ranges of g."""
    order = np.argsort(g)
    at = pos.astype(np.int64) << 16 | n.astype(np.int64) << 2 | state
    g, g2, key, at = (np.ascontiguousarray(x[order]).view(np.uint64) for x in (g, g2, key, at))
    part = ((g >> np.uint64(BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
    starts = groups(part)
    ends = np.append(starts[1:], len(g))
    step = g.copy()
    step[1:] -= g[:-1]
    step[starts] = g[starts]
    rows = [_bytes([step, g2, key, at], a, b) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(rows, pa.binary())], ["part", "n", "rows"])


def apart(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A hash of its own for each place."""
    with np.errstate(over="ignore"):
        return scan.mix(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal rows in sorted order."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def at_two_places(starts: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each group of rows, whether its places differ."""
    if not len(starts):
        return np.zeros(0, bool)
    differ = np.zeros(len(starts), bool)
    for x in (key, pos):
        differ |= np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)
    return differ


def _twice(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [_columns(raw, n) for n, raw in held]
    g = np.concatenate([np.cumsum(c[0]) for c in columns])
    g2, key, at = (np.concatenate([c[k] for c in columns]) for k in (1, 2, 3))
    order = np.lexsort((g2, g))
    g, g2, key, at = g[order], g2[order], key[order].view(np.int64), at[order].view(np.int64)
    starts = groups(g, g2)
    two = at_two_places(starts, key, pos_of(at)) | (np.maximum.reduceat(state_of(at), starts) > UNKNOWN)
    keep = np.repeat(two, np.diff(np.append(starts, len(g))))
    return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (g, g2, key, at)], NAMES)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        for part, n, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if held and part != last:
                yield _twice(held)
                held = []
            last = part
            held.append((n, rows))
    if held:
        yield _twice(held)


def repeated(dealt: DataFrame) -> DataFrame:
    """Rows whose (g, g2) stands at two places at least, or whose state says so.

    Ranges of hashes are dealt to partitions by their number, as many to each, and
    meet one after another, each small: there are more of them the more shuffle
    partitions there are, and a hash comes about once a batch."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part").mapInArrow(_gathered, SCHEMA)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds and flat values of a list column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(lengths)).astype(np.int64), column.flatten()
