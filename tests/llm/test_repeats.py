import hashlib

import numpy as np
import pytest

from ancestra.llm import cover, places, scan, suffix
from tests.llm.conftest import PROSE, WORD


def words_left(rows, window):
    """By brute force, of distinct (doc_id, text) rows."""
    told = list(dict.fromkeys(rows))
    words = [WORD.findall(t or "") for _, t in told]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = {}
    for row, w in zip(told, words):
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[row] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def check_words(table, window=35, **options):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = words_left(rows, window)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in cover.without_repeats(table, window, **options).collect())
    assert got == sorted((str(row[0]), *want[row]) for row in rows)


def test_words_against_brute_force(docs, hard):
    check_words(docs)
    check_words(hard)


def test_words_other_sizes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(map(str, rng.integers(0, 3, rng.integers(0, 60))))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    check_words(table, 6, period=4)
    check_words(table, 6, period=6)
    check_words(table, 6, period=1)


def test_difference_covers():
    for period in (1, 2, 7, 13, 21):
        d = cover.difference_cover(period)
        assert {(int(a) - int(b)) % period for a in d for b in d} == set(range(period))
    assert len(cover.difference_cover(21)) == 5


def bytes_left(rows, length):
    told = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for row in told:
        b = (row[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(k)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[row] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check_bytes(table, length=100, **options):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = bytes_left(rows, length)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(table, length, **options).collect())
    assert got == sorted((str(row[0]), *want[row]) for row in rows)


def test_bytes_against_brute_force(docs, hard):
    check_bytes(docs)
    check_bytes(hard)


def test_bytes_other_sizes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 80)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 700), (102, PROSE)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    check_bytes(table, 12, gram=5)
    check_bytes(table, 12, gram=12)


def test_places_in_texts_beyond_their_bits(monkeypatch):
    """Places are kept by their low bits, which tell them within a window."""
    raw = np.random.default_rng(4).integers(97, 100, 5000).astype(np.uint8)
    texts = scan.Texts(0, raw, np.array([0, 3000, 5000]))
    whole = suffix._segments(texts, 100, 32)
    monkeypatch.setattr(suffix, "_PLACE", np.uint64(8))
    assert all((a == b).all() for a, b in zip(whole, suffix._segments(texts, 100, 32)))


def test_ranges_of_anchors_are_even():
    """Least hashes are small ones, which must not put most anchors into the first ranges."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(60)]
    ids = pa.array(list(range(60)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["key", "doc_id", "text"])
    n = np.concatenate([out.column(1).to_numpy() for out in suffix._anchors(100, 32, 50)(iter([batch]))])
    assert len(n) == 50 and n.max() < 2 * n.mean()


def test_one_hash_with_many_bytes_is_solved_in_parts(monkeypatch):
    """Different segments of one hash, more than are sorted at once: right runs, and less text at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    common, lefts, rights = word(90), [word(40) for _ in range(9)], [word(40) for _ in range(9)]
    rows = []
    for k in range(400):
        a = lefts[int(rng.integers(0, 9))] if k % 3 else word(40)
        b = rights[int(rng.integers(0, 9))] if k % 4 else word(40)
        text = (a + common + b)[int(rng.integers(0, 30)) : -int(rng.integers(1, 30))]
        rows.append((5, hash(text), k // 2, k // 2, 1000 * (k % 2), len(text) - 99, False, text))
    names = [f.split()[0] for f in suffix._PIECES.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names)
    seen, wanted = {}, set()
    for _, _, _, key, pos, n, _, text in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        for i in range(n):
            window = text[i : i + 100]
            if seen.setdefault(window, (key, pos + i)) != (key, pos + i):
                wanted |= {(key, pos + i + j) for j in range(100)}
    sizes: list[int] = []
    sort = suffix.earlier_windows
    monkeypatch.setattr(suffix, "earlier_windows", lambda text, *rest: sizes.append(len(text)) or sort(text, *rest))
    most = []
    for limit in (1 << 30, 3000):
        monkeypatch.setattr(suffix, "MOST", limit)
        monkeypatch.setattr(suffix, "TEXT", min(limit, suffix.TEXT))
        sizes.clear()
        runs = [r for out in suffix._covered_runs(100, 32)(iter([batch])) for r in out.to_pylist()]
        assert {(r["key"], r["start"] + j) for r in runs for j in range(r["size"])} == wanted
        most.append(max(sizes))
    assert most[1] < most[0] / 3


@pytest.mark.parametrize("size,letters", [(0, 2), (1, 2), (60, 2), (400, 3), (2000, 2), (2000, 200)])
def test_two_stage_sort(size, letters):
    text = np.random.default_rng(size + letters).integers(0, letters, size).astype(np.uint8)
    if size == 400:
        text[100:300] = 1
    word, rank = suffix._ranks(text, 104 + 64)
    order = suffix.two_stage_sort(text, rank, 104)
    raw = text.tobytes()
    assert sorted(order) == list(range(size))
    tops = [raw[i : i + 104].ljust(104, b"\0") for i in order]
    assert tops == sorted(tops)
    shared = suffix.common_prefixes(order, word, 100)
    for i in range(1, size):
        a, b = tops[i - 1][:100], tops[i][:100]
        assert shared[i] == next((k for k in range(100) if a[k] != b[k]), 100)


def test_columns_survive_packing():
    rng = np.random.default_rng(3)
    n = 500
    g, g2 = (rng.integers(0, 1 << 48, n).astype(np.uint64) for _ in range(2))
    key = rng.integers(-(1 << 60), 1 << 60, n)
    batch = places.scatter(g, g2, key, np.arange(n), np.full(n, 7), np.full(n, places.KNOWN), 13)
    got = places._twice
    rows = set()
    for part, size, raw in zip(*(c.to_pylist() for c in batch.columns)):
        out = got([(size, raw)])
        assert 0 <= part < 13
        rows |= set(zip(*(c.to_pylist() for c in out.columns)))
    assert rows == set(zip(g.astype(np.int64).tolist(), g2.astype(np.int64).tolist(), key.tolist(), [int(i) << 16 | 7 << 2 | 1 for i in range(n)]))


def test_words_of_a_block_do_not_cross_documents():
    import pyarrow as pa

    column = pa.array(["ab cd", None, "", "ef", " gh "])
    for texts in scan.blocks(column):
        found = scan.words(texts)
        assert [bytes(texts.data[a:b]) for a, b in zip(found.starts, found.ends)] == [b"ab", b"cd", b"ef", b"gh"]
        assert found.bounds.tolist() == [0, 2, 2, 2, 3, 4]


def test_empty(empty):
    assert cover.without_repeats(empty).count() == 0
    assert suffix.without_repeats(empty).count() == 0
