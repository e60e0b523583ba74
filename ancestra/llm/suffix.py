"""Substring dedup of bytes with suffix arrays sorted in two stages.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller doc_id, or earlier in the same one.

1. Each window of ``length`` bytes is assigned to the smallest hash of its short
   grams, so that equal windows have equal hashes; consecutive windows with one
   hash make a segment. Segments whose hash stands at one place only are done.
2. Segments of one hash meet in one task. Copies of a segment after its first
   are wholly covered; the different ones are joined to a text, and a suffix
   array of that text is built in two stages: only suffixes whose first byte is
   not greater than the next are sorted directly, all others are induced by one
   scan over the buckets of first bytes.
   Segments of one hash with more than MOST bytes are first parted by the least
   hashes of other orders, without the windows that stand there once.
3. Common prefixes of adjacent suffixes part the windows into classes of equal
   strings; all but the earliest window of a class are covered.

Defined cases: a null or empty text has no bytes; rows equal in doc_id and text
count as one document and get the same result; rows that share only the doc_id
are ordered by a hash; null doc_ids come before all others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import places, scan

LENGTH = 100
GRAM = 32

#: Windows in a segment at most; longer runs of one hash are cut.
RUN = 4096

#: Bytes of segments that are sorted together, unless one hash has more.
TEXT = 1 << 18

#: Bytes of one hash from which on its windows are parted again, and how often at most.
MOST, DEPTH = 1 << 20, 8

_MAX = np.uint64(2**64 - 1)


def _ranks(text: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place's next eight bytes, as a number and as its rank; zeros follow the text."""
    n = len(text) + room
    padded = np.zeros(n + 8, np.uint64)
    padded[: len(text)] = text
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n]
    return word, np.unique(word, return_inverse=True)[1].astype(np.int64)


def _sort_direct(at: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the given places in order of their first depth bytes.

    Ranks of eight bytes are packed into one integer with the number of the group
    that is still tied, so each round sorts several words deep at once."""
    bits = max(int(rank.max(initial=0)).bit_length(), 1)
    new = np.zeros(len(at), bool)
    if len(new):
        new[0] = True
    done = 0
    while done < depth and len(at):
        tied = np.ones(len(at), bool)
        if done:
            size = np.diff(np.append(np.flatnonzero(new), len(at)))
            tied = np.repeat(size > 1, size)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = np.cumsum(new[where]) - 1
        words = max((63 - int(key[-1]).bit_length()) // bits, 1)
        for k in range(words):
            key = key << bits | rank[at[where] + done + 8 * k]
        order = np.argsort(key, kind="stable")
        at[where] = at[where][order]
        key = key[order]
        new[where[1:]] |= key[1:] != key[:-1]
        done += 8 * words
    return at


def two_stage_sort(text: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first depth bytes.

    rank: of eight bytes at each place, for depth + 8 places beyond the text's end."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    chars = text.astype(np.int64)
    direct = np.zeros(n, bool)
    direct[:-1] = text[:-1] <= text[1:]
    sorted_direct = _sort_direct(np.flatnonzero(direct), rank, depth)
    size = np.bincount(chars, minlength=256)
    start = np.cumsum(size) - size
    own = np.bincount(chars[sorted_direct], minlength=256)
    out = np.empty(n, np.int64)
    c = chars[sorted_direct]
    out[(start + size - own)[c] + np.arange(len(c)) - (np.cumsum(own) - own)[c]] = sorted_direct
    free = start.copy()
    out[free[chars[n - 1]]] = n - 1  # before the empty suffix, the smallest of all
    free[chars[n - 1]] += 1
    for char in np.flatnonzero(size):
        before = out[start[char] : start[char] + size[char]] - 1
        before = before[before >= 0]
        before = before[chars[before] > char]
        c = chars[before]
        order = np.argsort(c.astype(np.uint8), kind="stable")
        c = c[order]
        added = np.bincount(c, minlength=256)
        out[free[c] + np.arange(len(c)) - (np.cumsum(added) - added)[c]] = before[order]
        free += added
    return out


def common_prefixes(suffixes: np.ndarray, word: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, up to limit."""
    out = np.zeros(len(suffixes), np.int64)
    alive = np.arange(1, len(suffixes))
    for done in range(0, limit, 8):
        a, b = word[suffixes[alive] + done], word[suffixes[alive - 1] + done]
        same = a == b
        apart = (a ^ b)[~same]
        whole = np.zeros(len(apart), np.int64)
        for k in range(1, 8):
            whole += apart < np.uint64(1 << (64 - 8 * k))
        out[alive[~same]] = done + whole
        alive = alive[same]
    out[alive] = limit
    return np.minimum(out, limit)


def earlier_windows(text: np.ndarray, windows: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal one that comes before them in the given order."""
    depth = -(-length // 8) * 8
    word, rank = _ranks(text, depth + 8 * 8)
    is_window = np.full(len(text), -1, np.int64)
    is_window[windows] = order
    suffixes = two_stage_sort(text, rank, depth)
    suffixes = suffixes[is_window[suffixes] >= 0]
    out = np.zeros(len(text), bool)
    if len(suffixes):
        starts = np.flatnonzero(common_prefixes(suffixes, word, length) < length)
        when = is_window[suffixes]
        first = np.repeat(np.minimum.reduceat(when, starts), np.diff(np.append(starts, len(when))))
        out[suffixes[when > first]] = True
    return out[windows]


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of size values; the last places see fewer."""
    out, n = values, 1
    while 2 * n <= size:
        out = out.copy()
        out[:-n] = np.minimum(out[:-n], out[n:])
        n *= 2
    if size > n and len(out) > size - n:
        out = out.copy()
        k = size - n
        out[:-k] = np.minimum(out[:-k], out[k:])
    return out


#: A gram's place takes so many bits beside those of its hash.
_PLACE = np.uint64(28)


def _segments(texts: scan.Texts, length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Hash, first window, number of windows, hash of the bytes of each segment, and
    whether its hash stands at two places within it. Another salt is another order of hashes.

    The hash returned is mixed again, as least ones are small and ranges of them uneven.
    The smallest hash of a window is taken by its first 36 bits, the leftmost of
    equal ones, so it depends on the window's bytes alone."""
    prefix = scan.prefix_hash(scan.byte_values(texts.data, 0), 0)
    at = scan.windows(texts.bounds, gram)
    hashes = scan.run_hash(prefix, at, at + gram, 0)
    hashes = scan.mix(hashes ^ np.uint64(salt)) if salt else hashes
    marked = np.full(len(texts.data), _MAX, np.uint64)
    low = (1 << int(_PLACE)) - 1
    marked[at] = hashes >> _PLACE << _PLACE | (at & low).astype(np.uint64)
    windows = scan.windows(texts.bounds, length)
    place = (_least(marked, length - gram + 1)[windows] & np.uint64(low)).astype(np.int64)
    place = windows + ((place - windows) & low)  # within the window, also in texts of more than 2 ** 28 bytes
    full = np.zeros(len(texts.data), np.uint64)
    full[at] = hashes
    least = full[place]
    new = np.ones(len(windows), bool)
    new[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    if len(n) and n.max() > RUN:
        parts = -(-n // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + k * RUN
        n = np.minimum(np.repeat(n, parts) - k * RUN, RUN)
    start = windows[first]
    within = place[first] != place[first + n - 1]
    return scan.mix(least[first]), start, n, scan.run_hash(prefix, start, start + n + length - 1, 0), within


def _order_of(doc_id: pa.Array) -> np.ndarray:
    """doc_ids as integers, null before all."""
    return doc_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _anchors(length: int, gram: int, ranges: int):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids = batch.column(0).to_numpy(), _order_of(batch.column(1))
            fresh = places.first_rows(key)
            parts = []
            for texts in scan.blocks(batch.column(2)):
                g, start, n, content, within = _segments(texts, length, gram)
                doc = np.searchsorted(texts.bounds, start, "right") - 1
                row, use = texts.first + doc, fresh[texts.first + doc]
                parts.append([x[use] for x in (g >> places.SHORT, content, ids[row], key[row], start - texts.bounds[doc], n, within)])
            if not parts:
                continue
            g, content, ids, key, pos, n, within = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((content, g))
            g, content, ids, key, pos, n, within = (x[order] for x in (g, content, ids, key, pos, n, within))
            # only groups of several rows need the full order
            size = np.diff(np.append(places.groups(g), len(g)))
            many = np.flatnonzero(np.repeat(size > 1, size))
            inner = many[np.lexsort((pos[many], key[many], ids[many], content[many], g[many]))]
            for x in (g, content, ids, key, pos, n, within):
                x[many] = x[inner]
            starts = places.groups(g)
            two = places.at_two_places(starts, key, pos)
            state = np.repeat(np.where(two, places.KNOWN, places.UNKNOWN), np.diff(np.append(starts, len(g))))
            state[within] = places.KNOWN
            later = np.zeros(len(g), bool)
            later[1:] = (g[1:] == g[:-1]) & (content[1:] == content[:-1])
            state[later] = places.SETTLED
            g[later] = places.apart(key[later], pos[later]) >> places.SHORT
            yield places.scatter(g, np.zeros_like(g), key, pos, n, state, ranges)

    return anchored


_PIECES = "h long, content long, doc_order long, key long, pos long, n long, settled boolean, bytes binary"


def _binary(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of each run of data."""
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    raw = data[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())


def _raw(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the bounds of its values."""
    raw = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(length: int):
    """Segments with their bytes; those that are settled without."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PIECES.split(", ")]
        for batch in batches:
            key, ids = batch.column(0).to_numpy(), _order_of(batch.column(1))
            bounds, values = places.lists(batch.column(3))
            h, at = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("g", "at"))
            pos, n, state = places.pos_of(at), places.n_of(at), places.state_of(at)
            for texts in scan.blocks(batch.column(2)):
                lo, hi = bounds[texts.first], bounds[texts.first + texts.n]
                if lo == hi:
                    continue
                row = np.repeat(np.arange(texts.n), np.diff(bounds[texts.first : texts.first + texts.n + 1]))
                a = pos[lo:hi] + texts.bounds[row]
                settled = state[lo:hi] == places.SETTLED
                size = np.where(settled, 0, n[lo:hi] + length - 1)
                prefix = scan.prefix_hash(scan.byte_values(texts.data, 1), 1)
                content = scan.run_hash(prefix, a, a + size, 1).view(np.int64)
                raw = _binary(texts.data, a, size)
                columns = [pa.array(x) for x in (h[lo:hi], content, ids[texts.first + row], key[texts.first + row], pos[lo:hi], n[lo:hi], settled)]
                yield pa.RecordBatch.from_arrays([*columns, raw], names)

    return cut


def _parted(table: pa.Table, length: int, gram: int, salt: int) -> pa.Table:
    """The windows of different segments of one hash that may stand there twice, as
    segments by another order of hashes, sorted. A window that no other equals is left out:
    counts of cells of hashes tell most of them."""
    data, bounds = _raw(table.column(7))
    ids, key, pos = (table.column(k).to_numpy() for k in (2, 3, 4))
    cells = np.zeros(1 << max(16, int(table.column(5).to_numpy().sum()).bit_length() + 1), np.uint8)

    def blocks() -> Iterator[tuple[scan.Texts, np.ndarray, np.ndarray]]:
        at = 0
        while at < len(pos):
            end = max(int(np.searchsorted(bounds, bounds[at] + scan.BLOCK, "right")) - 1, at + 1)
            texts = scan.Texts(at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
            windows = scan.windows(texts.bounds, length)
            hashes = scan.run_hash(scan.prefix_hash(scan.byte_values(texts.data, 1), 1), windows, windows + length, 1)
            yield texts, windows, (hashes & np.uint64(len(cells) - 1)).astype(np.int64)
            at = end

    for _, _, cell in blocks():
        cell, times = np.unique(cell, return_counts=True)
        cells[cell] = np.minimum(cells[cell] + np.minimum(times, 2), 2)
    out = []
    for texts, windows, cell in blocks():
        windows = windows[cells[cell] > 1]
        if not len(windows):
            continue
        row = np.searchsorted(texts.bounds, windows, "right") - 1
        first = places.groups(row, windows - np.arange(len(windows)))
        start, row, size = windows[first], row[first], np.diff(np.append(first, len(windows))) + length - 1
        ends = np.append(0, np.cumsum(size))
        part = scan.Texts(0, texts.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends)
        h, at, n, content, _ = _segments(part, length, gram, salt)
        run = np.searchsorted(ends, at, "right") - 1
        owner = texts.first + row[run]
        place = pos[owner] + start[run] - texts.bounds[row[run]] + at - ends[run]
        columns = [pa.array(x) for x in (h.view(np.int64), content.view(np.int64), ids[owner], key[owner], place, n, np.zeros(len(n), bool))]
        out.append(pa.RecordBatch.from_arrays([*columns, _binary(part.data, at, n + length - 1)], table.schema.names))
    found = pa.Table.from_batches(out) if out else table.slice(0, 0)
    return found.take(pa.array(np.argsort(found.column(0).to_numpy(), kind="stable")))


def _covered_runs(length: int, gram: int):
    names = ["key", "start", "size"]

    def runs_of(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, start, size)], names)

    def solved(table: pa.Table) -> pa.RecordBatch:
        h, content, ids, key, pos, n = (table.column(k).to_numpy() for k in range(6))
        rows = np.lexsort((pos, key, ids, content, h))
        h, content, ids, key, pos, n = (x[rows] for x in (h, content, ids, key, pos, n))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (content[1:] != content[:-1])
        again = np.zeros(len(h), bool)
        again[1:] = ~new[1:] & (key[1:] == key[:-1]) & (pos[1:] == pos[:-1])
        copy = ~new & ~again
        key_of, pos_of, n_of = key[copy], pos[copy], n[copy]
        out = [(key_of, pos_of, n_of + length - 1)]
        picked = rows[new]
        raw = table.column(7).combine_chunks().take(pa.array(picked)).cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        text = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        at = offsets[:-1] - offsets[0]
        key, pos, n, ids = key[new], pos[new], n[new], ids[new]
        place = np.empty(len(n), np.int64)
        place[np.lexsort((pos, key, ids))] = np.arange(len(n))
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = np.repeat(at, n) + inside
        hit = np.zeros(len(text) + 1, bool)
        hit[windows] = earlier_windows(text, windows, np.repeat(place, n) * (RUN + 1) + inside, length)
        change = np.diff(hit.astype(np.int8), prepend=np.int8(0))
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        owner = np.searchsorted(at, first, "right") - 1
        out.append((key[owner], pos[owner] + first - at[owner], last - first + length - 1))
        return runs_of(*(np.concatenate(x) for x in zip(*out)))

    def solved_in_parts(table: pa.Table, depth: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash. Different segments of one hash with many bytes are parted by
        the least hashes of another order; equal windows stay together, so each part is solved alone."""
        starts = places.groups(table.column(0).to_numpy())
        ends = np.append(starts[1:], table.num_rows)
        total = np.append(0, np.cumsum(table.column(5).to_numpy() + length - 1))
        at = 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            if total[b] - total[a] > MOST and depth < DEPTH:
                if a > at:
                    yield solved(table.slice(at, a - at))
                content, ids, key, pos, n = (table.column(k).slice(a, b - a).to_numpy() for k in range(1, 6))
                order = np.lexsort((pos, key, ids, content))
                later = np.zeros(b - a, bool)
                later[1:] = content[order][1:] == content[order][:-1]
                again = np.zeros(b - a, bool)
                again[1:] = later[1:] & (key[order][1:] == key[order][:-1]) & (pos[order][1:] == pos[order][:-1])
                copy, first = order[later & ~again], order[~later]
                yield runs_of(key[copy], pos[copy], n[copy] + length - 1)
                part = _parted(table.slice(a, b - a).take(pa.array(first)), length, gram, depth + 1)
                if part.num_rows:
                    yield from solved_in_parts(part, depth + 1)
                at = b
            elif total[b] - total[at] >= TEXT:
                yield solved(table.slice(at, b - at))
                at = b
        if at < table.num_rows:
            yield solved(table.slice(at))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by hash; groups of one hash stay together."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            settled = batch.column(6).to_numpy(zero_copy_only=False)
            if settled.any():
                done = batch.filter(pa.array(settled))
                yield runs_of(done.column(3).to_numpy(), done.column(4).to_numpy(), done.column(5).to_numpy() + length - 1)
                batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            lengths = batch.column(5).to_numpy() + length - 1
            total = np.cumsum(lengths)
            cuts = places.groups(h)
            at = 0
            last = held[-1].column(0)[-1].as_py() if held else None
            for cut in cuts:
                before = size + (int(total[cut - 1]) if cut else 0) - (int(total[at - 1]) if at else 0)
                if before >= TEXT and (cut > 0 or h[0] != last):
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    yield from solved_in_parts(pa.Table.from_batches(held))
                    held, size, at = [], 0, int(cut)
            held.append(batch.slice(at))
            size += int(total[-1]) - (int(total[at - 1]) if at else 0)
        if held:
            yield from solved_in_parts(pa.Table.from_batches(held))

    return covered


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts, values = places.lists(batch.column(2))
        start, size = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "size"))
        out = []
        for texts in scan.blocks(batch.column(1)):
            lo, hi = cuts[texts.first], cuts[texts.first + texts.n]
            row = np.repeat(np.arange(texts.n), np.diff(cuts[texts.first : texts.first + texts.n + 1]))
            gone = scan.covered(start[lo:hi] + texts.bounds[row], size[lo:hi], len(texts.data))
            left = np.append(0, np.cumsum(~gone))[texts.bounds]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = texts.bounds[:-1][texts.bounds[:-1] < len(gone)]
            begins[edge] = gone[edge]
            spans = np.append(0, np.cumsum(begins))[texts.bounds]
            raw = memoryview(np.ascontiguousarray(texts.data[~gone]))
            sizes = np.diff(texts.bounds)
            digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
            out.append((sizes, sizes - np.diff(left), np.diff(spans), digest))
        if out:
            columns = [np.concatenate(x) for x in list(zip(*out))[:3]]
            digests = [d for part in out for d in part[3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs (key, start, size in bytes) that cover all bytes of rows (see places.keyed) to be removed."""
    if not 0 < gram <= length:
        raise ValueError("a gram must not be longer than the strings")
    ranges = places.parts_of(rows.sparkSession)
    anchors = places.repeated(rows.mapInArrow(_anchors(length, gram, ranges), places.DEALT))
    by_doc = anchors.groupBy("key").agg(F.collect_list(F.struct("g", "at")).alias("segments"))
    found = rows.repartition("key").join(by_doc, "key").select("key", "doc_id", "text", "segments")
    pieces = found.mapInArrow(_pieces(length), _PIECES).repartition("h").sortWithinPartitions("h")
    return pieces.mapInArrow(_covered_runs(length, gram), "key long, start long, size long")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = places.keyed(docs, places.ids_are_keys(docs))
    runs = covered_runs(rows, length, gram).groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    joined = rows.repartition("key").join(runs, "key", "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
