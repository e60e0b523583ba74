"""N-gram Jaccard join by vertical partitioning.

N-grams have one global order: rare ones by their hashes, then the common ones,
rarest first. What is common is counted over all documents: each of CELLS cells of
hashes counts the n-grams that would be keys if hashes alone gave the order, and
those of a cell with more than CROWD, and LOAD times the mean, are common. So there
are CELLS / LOAD such cells at most, whatever the size of the corpus.
Sets that link share an n-gram among the first few of each in that order, so
these n-grams are the keys by which candidates meet, and a passage of many
documents is a key only of those that consist of such passages.

Sets that hold the same key are first compared with one of them, the head, and
those that link are one component. Sets of one key that by their sizes and its places in them cannot link are parted at
once. Only groups whose
sets are in several components after that are looked at again: parity sketches of their sets are
compared in blocks (each n-gram flips one bit of its set's, so two sketches
differ in no more bits than the sets in n-grams), which names the sets that may
link with one of another component, in parts. The n-grams of a part's sets meet in one task,
which counts overlaps and returns only links that join components, fewer than
the part has sets. Pairs of sets are never rows there.

A pair is verified by vertical partitioning: both sets are cut at the same places
of the order of hashes, the overlap of each fragment is counted on its own, and
the counts are summed by pair.

Defined cases: without words or text a document's set is empty and links with
nothing; with fewer words than an n-gram has, the words are its only n-gram;
rows are taken one by one, also those that share a doc_id; a null doc_id stays
null and is never the id of a component with others; an empty table gives an
empty result; other columns are ignored. Sets and n-grams are told apart by 64
bits. Texts are read again where their sets are needed, and must be the same each time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import places, scan
from ancestra.llm.storage import checkpointed, free_name
from ancestra.operators.joins import components, looked_up

#: Cells of hashes, those that are summed in one row, and when a cell is crowded.
CELLS, PIECE = 1 << 22, 1 << 16
CROWD, LOAD = 256, 8

#: Keys that a task holds before it counts or deals them.
COUNTED = 1 << 18

#: Sets held at once that share a key from which on only one of them is dealt by it.
FOLLOWERS = 32

#: Sets that are compared with one head in one task, and heads with more at most.
GROUP, HEADS = 512, 1 << 16

#: Sets in a block at most, and the bytes of their n-grams.
BLOCK, BLOCK_BYTES = 4096, 1 << 23

#: Bits of a sketch for each n-gram by which linked sets may differ, and at least.
SKETCH_BITS, LEAST_BITS = 8, 512

#: N-grams of a set in one fragment, about.
FRAGMENT = 1 << 15

#: Documents up to whose number candidates are broadcast to the scan of texts (16 bytes each).
FEW = 500_000


def sets(texts: scan.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document in ascending order, and their bounds."""
    found = scan.words(texts)
    prefix = scan.prefix_hash(scan.word_hashes(texts, found, lower=True), 1)
    at = scan.windows(found.bounds, size)
    count = np.diff(found.bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    hashes = np.concatenate([scan.run_hash(prefix, at, at + size, 1), scan.run_hash(prefix, found.bounds[short], found.bounds[short + 1], 1)])
    doc = np.concatenate([found.doc[at], short])
    low = np.uint64(int(texts.n).bit_length())
    order = np.argsort(doc.astype(np.uint64) << (np.uint64(64) - low) | hashes >> low)
    hashes, doc = hashes[order], doc[order]
    if ((hashes[1:] < hashes[:-1]) & (doc[1:] == doc[:-1])).any():  # the bits that were sorted by are equal
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(texts.n + 1))


def differ(n: np.ndarray, percent: int) -> np.ndarray:
    """By how many n-grams a set of n differs at most from one that it links with.

    Linked sets of x <= y n-grams have y <= 100 x / percent, and share at least
    percent / (100 + percent) of x + y."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


def key_count(n: np.ndarray, percent: int) -> np.ndarray:
    """N-grams by which a set of n meets those that it may link with.

    Linked sets share percent of either at least, so the first n-grams up to one more
    than the others."""
    return n - -(-percent * n // 100) + 1


def key_places(hashes: np.ndarray, bounds: np.ndarray, percent: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in hashes) of the n-grams by which sets that may link meet, in order.

    classes: of each cell 0 if it is not crowded, else the more the more crowded."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.arange(len(hashes))
    if classes is not None:
        rank = classes[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]
        order = np.lexsort((hashes, rank, doc)) if rank.any() else order
    use = np.arange(len(hashes)) - bounds[:-1][doc] < key_count(n, percent)[doc]
    return doc[use], order[use]


def sketch_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the sketches of sets by size, powers of two."""
    return 2 ** np.ceil(np.log2(np.maximum(differ(n, percent) * SKETCH_BITS, LEAST_BITS))).astype(np.int64)


def parity_sketches(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> list[bytes]:
    """One bit flipped by each n-gram of a set."""
    n = np.diff(bounds)
    bits = sketch_bits(n, percent)
    start = np.append(0, np.cumsum(bits))
    doc = np.repeat(np.arange(len(n)), n)
    place = start[doc] + (hashes & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(start[-1])) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist())]


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return scan.run_hash(scan.prefix_hash(hashes, 6), bounds[:-1], bounds[1:], 6).view(np.int64)


_SEEN = "key long, doc_id long, n_shingles long, node long, piece int, counts binary"


def _surveyed(size: int, percent: int):
    """A row for each document, and at the end of a part rows (piece, counts) of its cells."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        held: list[np.ndarray] = []

        def count() -> None:
            nonlocal held
            cells, times = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
            counts[cells] += np.asarray(times, np.uint32)
            held = []

        for batch in batches:
            for texts in scan.blocks(batch.column(2)):
                hashes, bounds = sets(texts, size)
                columns = [batch.column(k).slice(texts.first, texts.n) for k in (0, 1)]
                none = [pa.nulls(texts.n, kind) for kind in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(_nodes(hashes, bounds)), *none], schema=schema)
                held.append((hashes[key_places(hashes, bounds, percent)[1]] & np.uint64(CELLS - 1)).astype(np.int64))
                if sum(map(len, held)) >= COUNTED:
                    count()
        count()
        pieces = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(counts.reshape(-1, PIECE)) if part.any()]
        if pieces:
            none = [pa.nulls(len(pieces), pa.int64()) for _ in range(4)]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(list(c), kind) for c, kind in zip(zip(*pieces), (pa.int32(), pa.binary())))], schema=schema)

    return surveyed


def _crowded(least: int):
    """Cells with least or more, and their classes; rows come sorted by piece."""

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches, 1):
            total = np.zeros(PIECE, np.int64)
            for _, raw in rows:
                total += np.frombuffer(zlib.decompress(raw), np.uint32)
            cell = np.flatnonzero(total >= least)
            yield pa.RecordBatch.from_arrays([pa.array(cell + rows[0][0] * PIECE), pa.array(1 + np.log2(total[cell] / least).astype(np.int64))], ["cell", "class"])

    return crowded


def crowded_cells(seen: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The crowded cells and their classes, CELLS / LOAD at most."""
    n = F.col("n_shingles")
    total = seen.where("n_shingles > 0").agg(F.sum(n - F.ceil(n * percent / 100) + 1)).first()[0] or 0
    least = max(CROWD, -(-total * LOAD // CELLS))
    pieces = seen.where("piece is not null").select("piece", "counts")
    rows = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(scan.giving_back(_crowded(least)), "cell long, class long").toPandas()
    return rows["cell"].to_numpy(np.int64), np.minimum(rows["class"].to_numpy(np.int64), 255).astype(np.uint8)


_KEYS = "gram long, node long, n long, head long, head_n long, many boolean, largest long"


def _keys(size: int, percent: int, crowded: tuple[np.ndarray, np.ndarray]):
    """Keys of sets, some at once. What comes before a key in a set is not shared by two sets
    of which it is the first shared one, so the key's place bounds the overlap, and thereby
    the size of the other set (largest), which may link and has this as first. Where
    FOLLOWERS or more share one, the least is its head among them and only the head is
    dealt by key (many: whether others follow)."""
    names = [f.split()[0] for f in _KEYS.split(", ")]
    cells, class_of = crowded

    def dealt(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, node, n, largest = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((node, gram))
        first = order[places.groups(gram[order], node[order])]
        gram, node, n, largest = gram[first], node[first], n[first], largest[first]
        starts = places.groups(gram)
        count = np.diff(np.append(starts, len(gram)))
        many = np.repeat(count >= FOLLOWERS, count)
        heads = (np.where(many, np.repeat(x[starts], count), x) for x in (node, n))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), node, n, *heads, many, largest)], names)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.zeros(CELLS, np.uint8)
        classes[cells] = class_of
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for texts in scan.blocks(batch.column(2)):
                hashes, bounds = sets(texts, size)
                n, node = np.diff(bounds), _nodes(hashes, bounds)
                doc, at = key_places(hashes, bounds, percent, classes)
                left = n[doc] - (np.arange(len(doc)) - np.searchsorted(doc, doc))
                parts.append((hashes[at] >> places.SHORT, node[doc], n[doc], left * (100 + percent) // percent - n[doc]))
                if sum(len(x[0]) for x in parts) >= COUNTED:
                    yield dealt(parts)
                    parts = []
        if parts:
            yield dealt(parts)

    return keys


_MEETING = "gram long, node long, n long, head long, head_n long"


def _meeting():
    """Rows come sorted by key and size.

    Where a set is larger than all sets before it of the same key allow for, another
    group begins, and a set alone in its group is left out. The least set of a group is
    its head. A key with followers stays one group, and followers stay as they are."""
    names = [f.split()[0] for f in _MEETING.split(", ")]

    def met(columns: list[np.ndarray]) -> pa.RecordBatch:
        follows = columns[1] != columns[3]
        rest = [c[follows] for c in columns[:5]]
        gram, node, n, _, _, many, largest = (c[~follows] for c in columns)
        starts = places.groups(gram)
        if len(starts):
            count = np.diff(np.append(starts, len(gram)))
            whole = np.repeat(np.logical_or.reduceat(many, starts), count)
            key = np.repeat(np.arange(len(starts)), count) << 40
            reach = np.maximum.accumulate(key + np.maximum(largest, 0)) - key
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (~whole[1:] & (n[1:] > reach[:-1]))
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(gram)))
            with np.errstate(over="ignore"):
                own = scan.mix(gram[starts].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n[starts].astype(np.uint64)).view(np.int64)
            gram = np.where(whole, gram, np.repeat(own, count))
            order = np.lexsort((node, np.repeat(np.arange(len(starts)), count)))
            gram, node, n, whole = gram[order], node[order], n[order], whole[order]
            head = np.repeat(starts, count)
            use = whole | np.repeat(node[starts] != node[starts + count - 1], count)
            use[1:] &= (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            found = [gram[use], node[use], n[use], node[head][use], n[head][use]]
        else:
            found = [gram, node, n, node, n]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(found, rest)], names)

    def meeting_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).copy() for c in batch.columns]
            if not batch.num_rows:
                continue
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[cut:] for c in columns]
            if cut:
                yield met([c[:cut] for c in columns])
        if held is not None:
            yield met(held)

    return meeting_of


def meeting(text: DataFrame, size: int, percent: int, crowded: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, node, n, head, head_n) of sets that share a key with another one."""
    keys = text.mapInArrow(scan.giving_back(_keys(size, percent, crowded)), _KEYS)
    follower = F.when(F.col("node") == F.col("head"), F.xxhash64("gram")).otherwise(F.xxhash64("gram", "node"))
    return keys.repartition(follower).sortWithinPartitions("gram", "n").mapInArrow(scan.giving_back(_meeting()), _MEETING)


def _of_texts(size: int, column: str, made):
    """Rows (node, n, column) of texts; made: what the column holds of their sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in scan.blocks(batch.column(0)):
                hashes, bounds = sets(texts, size)
                columns = [pa.array(_nodes(hashes, bounds)), pa.array(np.diff(bounds)), pa.array(made(hashes, bounds), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", column])

    return rows


def _values(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = hashes.astype("<u8").tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@dataclass
class Corpus:
    """Texts (see places.keyed), the key of one document of each set, and what links are."""

    text: DataFrame
    keys: DataFrame
    size: int
    percent: int

    def scanned(self, nodes: DataFrame, column: str) -> DataFrame:
        """(node, n, column) of the sets nodes: their sketches, or as value all their n-grams."""
        wanted = checkpointed(nodes.distinct().join(self.keys, "node").select("key"))
        wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        made = _values if column == "value" else partial(parity_sketches, percent=self.percent)
        return self.text.join(wanted, "key").select("text").mapInArrow(scan.giving_back(_of_texts(self.size, column, made)), f"node long, n long, {column} binary")

    def of(self, nodes: DataFrame, column: str) -> DataFrame:
        """The same, written, as it is used more than once."""
        return checkpointed(self.scanned(nodes, column))


def _folded(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(left: list[bytes], right: list[bytes], a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each left sketch of a set of size a with the right ones of sizes b that may link with it.

    Sketches are compared at the width of the shorter one, only with those of sizes
    that may link at all; widths grow with sizes, so these stand together."""
    order = np.argsort(b, kind="stable")
    sizes, width = b[order], np.array([len(right[k]) for k in order])
    tables: dict[int, tuple[int, np.ndarray]] = {}
    for k, (raw, n) in enumerate(zip(left, a)):
        lo, hi = np.searchsorted(sizes, [-(-percent * n // 100), n * 100 // percent + 1])
        if lo == hi:
            continue
        w = min(len(raw), int(width[lo]))
        if w not in tables:
            first, last = np.searchsorted(width, [w, 8 * w])
            tables[w] = int(first), np.stack([_folded(right[q], w) for q in order[first:last]])
        first, table = tables[w]
        total = n + sizes[lo:hi]
        least = -(-percent * total // (100 + percent))
        near = np.bitwise_count(_folded(raw, w) ^ table[lo - first : hi - first]).sum(1, dtype=np.int64) <= total - 2 * least
        yield k, order[lo:hi][near]


def _by_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first columns, which come sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_PAIR = "a long, a_n long, b long, b_n long"
_NAMES = [f.split()[0] for f in _PAIR.split(", ")]


def _pairs(rows: list[tuple], extra: str = "") -> pa.RecordBatch:
    names = _NAMES + ([extra] if extra else [])
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


def _sketched(percent: int):
    """Which members of a task may link with its head."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches, 2):
            heads = [r for r in rows if r[2] == r[0]]
            members = list({r[2]: r for r in rows if r[2] != r[0]}.values())
            if heads and members:
                found = may_link([heads[0][4]], [m[4] for m in members], np.array([heads[0][3]]), np.array([m[3] for m in members]), percent)
                yield _pairs([(rows[0][0], heads[0][3], *members[q][2:4]) for _, near in found for q in near])

    return judged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set in fragments of the order of hashes, as many as its head is long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        for head, salt, node, n, value, head_n in zip(*(c.to_pylist() for c in batch.columns)):
            parts = -(-head_n // FRAGMENT)
            if parts == 1:
                out.append((head, salt, 0, node, n, value))
                continue
            part = ((np.frombuffer(value, "<u8") >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            out += [(head, salt, k, node, n, value[8 * x : 8 * y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["a", "salt", "fragment", "node", "n", "value"])


def partial_overlaps(head: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each member shares with the head; all are sorted."""
    size = np.array([len(m) for m in members], np.int64)
    if not len(head) or not size.sum():
        return np.zeros(len(members), np.int64)
    values = np.concatenate(members)
    hit = head[np.minimum(np.searchsorted(head, values), len(head) - 1)] == values
    return np.bincount(np.repeat(np.arange(len(members)), size)[hit], minlength=len(members))


def _overlapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps within one fragment of the members of a task with its head."""
    for rows in _by_task(batches, 3):
        heads = [r for r in rows if r[3] == r[0]]
        members = list({r[3]: r for r in rows if r[3] != r[0]}.values())
        if heads and members:
            shared = partial_overlaps(np.frombuffer(heads[0][5], "<u8"), [np.frombuffer(m[5], "<u8") for m in members])
            yield _pairs([(rows[0][0], heads[0][4], m[3], m[4], x) for m, x in zip(members, shared.tolist())], "shared")


def _beside(pairs: DataFrame, material: DataFrame, column: str) -> DataFrame:
    """(a, salt, node, n, column, a_n): each b with the sets that have the same a, and a once
    among every few of them. Heads with many partners are HEADS at most, so they are broadcast."""
    total = pairs.count()
    each = max(GROUP, -(-total // HEADS))
    counts = pairs.groupBy("a").agg(F.count("*").alias("count"), F.first("a_n").alias("a_n"))
    counts = counts.withColumn("salts", F.ceil(F.col("count") / each).cast("int"))
    large = F.broadcast(counts.where("salts > 1").select(F.col("a").alias("many"), F.col("salts").alias("parts")))
    what = material.select("node", "n", column)
    members = pairs.select("a", "a_n", F.col("b").alias("node")).join(what, "node")
    parts = F.lit(1)
    if total > each:
        members, parts = members.join(large, F.col("a") == F.col("many"), "left"), F.coalesce("parts", F.lit(1))
    salt = F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt")
    heads = counts.join(what, F.col("a") == F.col("node")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    order = ["a", "salt", "node", "n", column, "a_n"]
    return members.select("a", salt, "node", "n", column, "a_n").unionByName(heads.select(*order))


def verified(pairs: DataFrame, sketches: DataFrame, corpus: Corpus) -> DataFrame:
    """Pairs (a, b) of those given that link."""
    percent = corpus.percent
    pairs = checkpointed(pairs)
    near = _beside(pairs, sketches, "sketch").drop("a_n").repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(scan.giving_back(_sketched(percent)), _PAIR)
    near = checkpointed(near)
    values = corpus.of(near.select(F.col("a").alias("node")).union(near.select("b")), "value")
    task = ["a", "salt", "fragment"]
    cut = _beside(near, values, "value").mapInArrow(scan.giving_back(_cut), "a long, salt long, fragment long, node long, n long, value binary")
    parts = cut.repartition(*task).sortWithinPartitions(*task).mapInArrow(scan.giving_back(_overlapped), f"{_PAIR}, shared long")
    summed = parts.groupBy(*_NAMES).agg(F.sum("shared").alias("shared"))
    return summed.where(100 * F.col("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))).select("a", "b")


_PART = "part long, node long, n long, root long"


def _near(percent: int):
    """Of the sets of a task's two blocks those that may link with one of another component,
    parted where no two of different parts may. Parts of the same sets have the same name."""

    def near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches, 3):
            i, j = rows[0][1:3]
            sides: dict[int, dict[int, tuple]] = {}
            for row in rows:
                sides.setdefault(row[3], {})[row[4]] = row[4:]
            left, right = (list(sides.get(k, {}).values()) for k in (i, j))
            if not left or not right:
                continue
            every, offset = (left, 0) if i == j else (left + right, len(left))
            node, n, root = (np.array([x[k] for x in every], np.int64) for k in range(3))
            part, use = np.arange(len(every)), np.zeros(len(every), bool)
            for k, near in may_link([x[3] for x in left], [x[3] for x in right], n[: len(left)], n[offset:], percent):
                near = near + offset
                near = near[(root[near] != root[k]) & (near > k)]
                if len(near):
                    use[near] = use[k] = True
                    part = _together(part, np.append(near, k))
            if use.any():
                part = part[use]
                name = np.zeros(len(every), np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(name, part, scan.mix(node[use].view(np.uint64)))
                columns = (name[part].view(np.int64), node[use], n[use], root[use])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["part", "node", "n", "root"])

    return near_sets


def _together(part: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the parts after those of ends have become one."""
    joined = np.unique(part[ends])
    if len(joined) == 1:
        return part
    new = np.arange(len(part))
    new[joined] = joined[0]
    return new[part]


def forest(values: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets (sorted n-grams) that join their components wherever links do, each
    two components but once: fewer than there are sets.

    A set is cut at as many places of the order as it is long, and so are those that it is
    compared with; overlaps are counted by fragment and summed."""
    n = np.array([len(x) for x in values], np.int64)
    bounds = np.append(0, np.cumsum(n))
    grams = np.concatenate(values)
    sketches = parity_sketches(grams, bounds, percent)
    distinct, ids = np.unique(grams, return_inverse=True)
    own = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    held = np.zeros(len(distinct), bool)
    part = np.unique(root, return_inverse=True)[1]
    out = []
    for k, near in may_link(sketches, sketches, n, n, percent):
        near = near[(part[near] != part[k]) & (near > k)]
        if not len(near):
            continue
        held[own[k]] = True
        shared = np.zeros(len(near), np.int64)
        cuts = np.linspace(0, len(distinct), -(-int(n[k]) // FRAGMENT) + 1).astype(np.int64)
        for low, high in zip(cuts, cuts[1:]):
            pieces = [own[q] if len(cuts) == 2 else own[q][slice(*np.searchsorted(own[q], [low, high]))] for q in near.tolist()]
            ends = np.append(0, np.cumsum([len(x) for x in pieces]))
            shared += np.diff(np.append(0, np.cumsum(held[np.concatenate(pieces)]))[ends])
        held[own[k]] = False
        links = near[100 * shared >= percent * (n[k] + n[near] - shared)]
        if len(links):
            out += [(k, int(q)) for q in links[np.unique(part[links], return_index=True)[1]]]
            part = _together(part, np.append(links, k))
    return out


def _forests(percent: int):
    """Links that join the components of the sets of a part; rows come sorted by it."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches, 1):
            members = list({r[1]: r for r in rows}.values())
            found = forest([np.frombuffer(r[3], "<u8") for r in members], np.array([r[2] for r in members]), percent)
            if found:
                columns = zip(*((members[k][1], members[q][1]) for k, q in found))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

    return joined


def open_groups(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, node, root) of groups whose sets are in several components; of groups with
    the same sets one. Of two sets, one has been compared with the other as its head."""
    rooted = met.select("gram", "node").join(roots, "node", "left").select("gram", "node", F.coalesce("root", "node").alias("root"))
    rooted = checkpointed(rooted)
    keys = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count"), F.bit_xor(F.xxhash64("node")).alias("print"))
    merged = keys.where("low <> high and count > 2").groupBy("count", "print", "low", "high").agg(F.min("gram").alias("gram")).select("gram")
    return rooted.join(checkpointed(merged), "gram")


def near_parts(met: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(part, node, n, root) of sets that meet in a group and may link with one of another
    component: any two such sets of a group are in one part."""
    groups = checkpointed(open_groups(met, roots)).join(sketches, "node")
    weights = groups.groupBy("gram").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    large = checkpointed(weights.where("n_blocks > 1"))
    blocks = F.coalesce("n_blocks", F.lit(1))
    dealt = groups.join(large, "gram", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", "sketch")
    task = ["gram", "i", "j"]
    return rows.repartition(*task).sortWithinPartitions(*task).mapInArrow(scan.giving_back(_near(percent)), _PART).distinct()


def left_over(met: DataFrame, roots: DataFrame, sketches: DataFrame, corpus: Corpus) -> DataFrame:
    """Links (a, b) that join the components of sets that meet in a group."""
    parts = checkpointed(near_parts(met, roots, sketches, corpus.percent))
    values = corpus.scanned(parts.select("node"), "value")
    rows = parts.join(values.select("node", "value"), "node").select("part", "node", "root", "value")
    return checkpointed(rows.repartition("part").sortWithinPartitions("part").mapInArrow(scan.giving_back(_forests(corpus.percent)), "a long, b long"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links between nodes of theirs, or of none, join components."""
    at = roots.select(F.col("node").alias("end"), F.col("root").alias("top"))
    for side in ("a", "b"):
        links = links.join(at, F.col(side) == F.col("end"), "left").select(*({"a", "b"} - {side}), F.coalesce("top", side).alias(side))
    tops = checkpointed(components(links.select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("new")))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).join(tops, "root", "left").select("root", F.coalesce("new", "root").alias("new"), "n")
    moved = looked_up(roots, sizes, "root", roots.count()).select("node", F.col("new").alias("root"))
    others = tops.join(roots.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))
    return checkpointed(moved.union(others))


def linked_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id, n_shingles, and root (one value a component) of each row."""
    text = places.keyed(docs)
    seen = checkpointed(text.mapInArrow(scan.giving_back(_surveyed(size, percent)), _SEEN))
    rows = seen.where("piece is null").drop("piece", "counts")
    met = checkpointed(meeting(text, size, percent, crowded_cells(seen, percent)))
    worded = rows.where("n_shingles > 0")
    keys = checkpointed(worded.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    corpus = Corpus(text, keys, size, percent)
    sketches = corpus.of(met.select("node"), "sketch")
    near_size = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    stars = met.where(F.col("node") != F.col("head")).where(near_size)
    links = checkpointed(verified(stars.select(F.col("head").alias("a"), F.col("head_n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n")).distinct(), sketches, corpus))
    roots = components(links)
    roots = joined_roots(roots, left_over(met, roots, sketches, corpus))
    rooted = keys.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n")
    found = looked_up(worded, rooted, "node", rows.count()).select("key", "doc_id", "n_shingles", "root")
    return found.union(rows.where("n_shingles = 0").select("key", "doc_id", "n_shingles", F.lit(None).cast("long")))


def linked(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    rows = checkpointed(linked_rows(docs, size, percent))
    worded = rows.where("root is not null")
    least = worded.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    found = looked_up(worded, least, "root", rows.count()).select("doc_id", "n_shingles", "component_id")
    return found.union(rows.where("root is null").select("doc_id", "n_shingles", F.col("doc_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates, with all their columns: of each component the
    row with the least doc_id stays, and all rows without words. Rows that are equal
    in doc_id and text are one document, of which the least in all columns stays."""
    rows = checkpointed(linked_rows(docs, size, percent))
    first = rows.where("root is not null").groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key"))
    own, wanted = free_name(docs, "own"), free_name(docs, "wanted")
    stay = first.select(F.col("key").alias(wanted)).union(rows.where("root is null").select("key")).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = marked.join(stay, F.col(own) == F.col(wanted), "left_semi")
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
        found = found.groupBy(own).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*others)) if others else F.lit(0)).alias(wanted)).select(f"{wanted}.*")
    return found.select(*docs.columns)
