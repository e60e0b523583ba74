"""Substring dedup of words by difference-cover anchors.

A difference cover modulo a period has, for any two positions, a common shift
within the period after which both lie in it. So if short windows are hashed
only where a word's place in its document, modulo the period, is in the cover,
two equal long windows share an aligned anchor, wherever they stand. Anchors
that stand at two places are then extended: the long windows around them are
hashed with 96 bits, and those at two places are removed.

Defined cases: a null or empty text has no words; rows equal in doc_id and text
count as one document and get the same result, rows that share only the doc_id
are different documents; a null doc_id stays null; an empty table gives an
empty result; other columns are ignored. Documents are told apart by 64-bit
hashes of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import places, scan

WINDOW = 35
PERIOD = 21


def difference_cover(period: int) -> np.ndarray:
    """A least set whose differences are all residues modulo period."""

    def extended(cover: list[int], missing: frozenset[int], room: int) -> list[int] | None:
        if not missing:
            return cover
        if not room or len(missing) > room * (2 * len(cover) + room - 1):
            return None
        for c in range(cover[-1] + 1, period):
            new = frozenset(d for a in cover for d in ((a - c) % period, (c - a) % period))
            if found := extended([*cover, c], missing - new, room - 1):
                return found
        return None

    for size in range(1, period + 1):
        if found := extended([0], frozenset(range(1, period)), size - 1):
            return np.array(found)
    raise ValueError("no period")


def _hashes(texts: scan.Texts, found: scan.Words, seed: int) -> np.ndarray:
    return scan.prefix_hash(scan.word_hashes(texts, found, seed), seed + 1)


def _anchors(window: int, period: int, ranges: int):
    size = window - period + 1
    chosen = np.isin(np.arange(period), difference_cover(period))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            fresh = places.first_rows(key)
            parts = []
            for texts in scan.blocks(batch.column(2)):
                found = scan.words(texts)
                at = scan.windows(found.bounds, size)
                doc = found.doc[at]
                pos = at - found.bounds[doc]
                use = chosen[pos % period] & fresh[texts.first + doc] & (np.diff(found.bounds)[doc] >= window)
                at, pos, doc = at[use], pos[use], doc[use]
                parts.append((scan.run_hash(_hashes(texts, found, 0), at, at + size, 1) >> places.SHORT, key[texts.first + doc], pos))
            if parts:
                yield settle(ranges, *(np.concatenate(x) for x in zip(*parts)))

    return anchored


def settle(ranges: int, g: np.ndarray, key: np.ndarray, pos: np.ndarray, g2: np.ndarray | None = None, known: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of a batch: where it shows a hash twice, one row tells the others of it."""
    g2 = np.zeros_like(g) if g2 is None else g2
    known = np.zeros(len(g), bool) if known is None else known
    order = np.lexsort((g2, g))
    g, g2, key, pos, known = g[order], g2[order], key[order], pos[order], known[order]
    starts = places.groups(g, g2)
    two = places.at_two_places(starts, key, pos)
    if len(starts):
        two |= np.logical_or.reduceat(known, starts)
    size = np.diff(np.append(starts, len(g)))
    state = np.repeat(np.where(two, places.KNOWN, places.UNKNOWN), size)
    alone = np.repeat(two, size)
    alone[starts] = False
    g, g2 = np.where(alone, places.apart(key, pos) >> places.SHORT, g), np.where(alone, np.uint64(0), g2)
    return places.scatter(g, g2, key, pos, np.ones(len(g), np.int64), state, ranges)


def _windows(window: int, period: int, ranges: int):
    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            fresh = places.first_rows(key)
            cuts, values = places.lists(batch.column(3))
            anchor = values.to_numpy(zero_copy_only=False).astype(np.int64)
            copied = batch.column(4).to_numpy(zero_copy_only=False)
            parts = []
            for texts in scan.blocks(batch.column(2)):
                found = scan.words(texts)
                lo, hi = cuts[texts.first], cuts[texts.first + texts.n]
                doc = np.repeat(np.arange(texts.n), np.diff(cuts[texts.first : texts.first + texts.n + 1]))
                at = anchor[lo:hi] + found.bounds[doc]
                first = np.maximum(at - period + 1, found.bounds[doc])
                last = np.minimum(at, found.bounds[doc + 1] - window)
                some = (last >= first) & fresh[texts.first + doc]
                at = np.flatnonzero(scan.covered(first[some], (last - first + 1)[some], int(found.bounds[-1])))
                doc = found.doc[at]
                hashes = [scan.run_hash(_hashes(texts, found, seed), at, at + window, seed + 1) for seed in (0, 2)]
                row = texts.first + doc
                parts.append((hashes[0] >> places.SHORT, key[row], at - found.bounds[doc], hashes[1] >> places.SHORT, copied[row]))
            if parts:
                yield settle(ranges, *(np.concatenate(x) for x in zip(*parts)))

    return extended


def _removed(window: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, values = places.lists(batch.column(2))
            start = values.to_numpy(zero_copy_only=False).astype(np.int64)
            copied = batch.column(3).to_numpy(zero_copy_only=False)
            total, gone, digest = [], [], []
            for texts in scan.blocks(batch.column(1)):
                found = scan.words(texts)
                n = int(found.bounds[-1])
                doc = np.repeat(np.arange(texts.n), np.diff(cuts[texts.first : texts.first + texts.n + 1]))
                at = start[cuts[texts.first] : cuts[texts.first + texts.n]] + found.bounds[doc]
                kept = ~scan.covered(at, window, n)
                kept &= ~(copied[texts.first : texts.first + texts.n] & (np.diff(found.bounds) >= window))[found.doc]
                count = np.append(0, np.cumsum(kept))[found.bounds]
                a, size = found.starts[kept], (found.ends - found.starts)[kept] + 1
                ends = np.append(0, np.cumsum(size))
                source = np.repeat(a - ends[:-1], size) + np.arange(ends[-1])
                out = np.append(texts.data, np.uint8(32))[source]
                out[ends[1:] - 1] = 32
                raw = memoryview(out)
                total += np.diff(found.bounds).tolist()
                gone += (np.diff(found.bounds) - np.diff(count)).tolist()
                bounds = ends[count].tolist()
                digest += [hashlib.sha256(raw[x : max(y - 1, x)]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed


def repeated_windows(rows: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """key and pos (in words) of windows of rows (see places.keyed) that also start elsewhere.

    Of documents with equal texts only the first is searched."""
    if not 0 < period <= window:
        raise ValueError("the period must not be longer than the window")
    ranges = places.parts_of(rows.sparkSession)
    anchors = places.repeated(rows.mapInArrow(_anchors(window, period, ranges), places.DEALT))
    by_doc = anchors.groupBy("key").agg(F.collect_list(places.pos_of(F.col("at")).cast("int")).alias("anchors"))
    by_doc = by_doc.join(copies(rows), "key", "left").where("first is null or first")
    found = rows.repartition("key").join(by_doc, "key").select("key", "doc_id", "text", "anchors", F.col("first").isNotNull().alias("copied"))
    return places.repeated(found.mapInArrow(_windows(window, period, ranges), places.DEALT)).select("key", places.pos_of(F.col("at")).cast("int").alias("pos"))


def copies(rows: DataFrame) -> DataFrame:
    """key of each document whose whole text another one has, and whether it is the first."""
    hashed = rows.select("key", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("copy"), "text").alias("b"))
    several = hashed.groupBy("a", "b").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    return hashed.join(several, ["a", "b"]).groupBy("key").agg(F.max(F.col("key") == F.col("least")).alias("first"))


def without_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """What is left of each document: doc_id, n_words, n_removed, kept_sha256.

    A document that another one copies whole loses all its words, if it has a window
    at all; only the first of such documents takes part in the search of others."""
    rows = places.keyed(docs, places.ids_are_keys(docs))
    starts = repeated_windows(rows, window, period).groupBy("key").agg(F.collect_list("pos").alias("starts"))
    joined = rows.repartition("key").join(starts, "key", "left").join(copies(rows), "key", "left")
    return joined.select("doc_id", "text", "starts", F.col("first").isNotNull().alias("copied")).mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
