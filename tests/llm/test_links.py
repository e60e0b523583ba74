import numpy as np
import pyarrow as pa

from ancestra.llm import jaccard
from ancestra.operators import joins
from tests.llm.conftest import PROSE, WORD

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})


def groups_of(rows, size, percent):
    """For each row the least row of its component."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def components_of(rows, size, percent):
    """Rows with words, by component."""
    root, sets = groups_of(rows, size, percent)
    return [[rows[j] for j in range(len(rows)) if root[j] == r] for r in sorted({root[i] for i in range(len(rows)) if sets[i]})]


def brute(rows, size, percent):
    """doc_id, set size and component of each row."""
    root, sets = groups_of(rows, size, percent)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((str(d), len(sets[i]), str(min(ids) if ids and sets[i] else d)))
    return sorted(out)


def check(table, size=3, percent=90):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked(table, size, percent).collect())
    assert got == brute(rows, size, percent)


def near_copies(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(4):
        words = [f"w{x}" for x in rng.integers(0, 400, 60 + 90 * base)]
        for k in range(n // 4):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4 + base))):
                copy[int(rng.integers(0, len(copy)))] = f"x{rng.integers(0, 9)}"
            if k % 7 == 0:
                copy = copy[: -int(rng.integers(1, 9))]
            rows.append((len(rows), " ".join(copy)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_links_against_brute_force(spark, docs, hard):
    check(docs)
    check(hard)
    check(near_copies(spark))
    check(near_copies(spark, seed=5), 5, 80)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "GROUP", 7)
    check(near_copies(spark, seed=2))


def test_fragments_are_summed_by_pair(monkeypatch):
    """Sets cut at the same places of the order: overlaps of the fragments add up to those of the sets."""
    monkeypatch.setattr(jaccard, "FRAGMENT", 100)
    rng = np.random.default_rng(3)
    sets = {k: np.unique(rng.integers(0, 2**63, 900).astype(np.uint64) >> np.uint64(51) << np.uint64(51)) for k in range(1, 6)}
    rows = [(1, 0, k, len(v), v.astype("<u8").tobytes(), len(sets[1])) for k, v in sets.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["a", "salt", "node", "n", "value", "a_n"])
    cut = next(jaccard._cut(iter([batch])))
    assert len(set(cut.column(2).to_pylist())) == -(-len(sets[1]) // 100) > 5
    order = sorted(range(cut.num_rows), key=lambda i: tuple(cut.column(k)[i].as_py() for k in range(3)))
    shared = {}
    for out in jaccard._overlapped(iter([cut.take(order)])):
        for a, _, b, _, n in zip(*(c.to_pylist() for c in out.columns)):
            shared[a, b] = shared.get((a, b), 0) + n
    assert shared == {(1, k): len(np.intersect1d(sets[1], sets[k])) for k in range(2, 6)} and min(shared.values()) > 0


def test_a_passage_in_all_documents(spark, monkeypatch):
    """Documents that share a passage but no more are no links; copies of it are."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in range(60))
    monkeypatch.setattr(jaccard, "CROWD", 100)
    rows = [(k, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 50))))) for k in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    classes = (rng.integers(0, 3, jaccard.CELLS) * (rng.random(jaccard.CELLS) < 0.5)).astype(np.uint8)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(1, 60))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a[: int(np.ceil(n * percent / 100))] if rng.random() < 0.5 else np.concatenate([a[: n - n // 20], rng.integers(0, 2**63, n // 20).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            hashes = np.concatenate([a, b])
            doc, at = jaccard.key_places(hashes, np.array([0, len(a), len(a) + len(b)]), percent, classes)
            assert set(hashes[at[doc == 0]].tolist()) & set(hashes[at[doc == 1]].tolist())


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000))).astype(np.uint64)) for _ in range(40)]
        sets += [np.unique(np.concatenate([a[int(len(a) * rng.random() * 0.15) :], rng.integers(0, 2**63, int(len(a) * rng.random() * 0.1)).astype(np.uint64)])) for a in sets]
        n = np.array([len(x) for x in sets])
        sketches = jaccard.parity_sketches(np.concatenate(sets), np.append(0, np.cumsum(n)), percent)
        found = {(k, q) for k, near in jaccard.may_link(sketches, sketches, n, n, percent) for q in near.tolist()}
        for k, a in enumerate(sets):
            for q, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert (k, q) in found or 100 * both < percent * (len(a) + len(b) - both)
        assert len(found) < 200


def test_many_near_sets_make_no_rows_of_pairs():
    """Sets that all may link with one another by their sketches, and do not: a row each at most."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 2**63, 340).astype(np.uint64)
    sets = [np.unique(np.concatenate([core, rng.integers(0, 2**63, 21).astype(np.uint64)])) for _ in range(60)]
    n = np.array([len(x) for x in sets])
    sketches = jaccard.parity_sketches(np.concatenate(sets), np.append(0, np.cumsum(n)), 90)
    pairs = sum(len(near) for _, near in jaccard.may_link(sketches, sketches, n, n, 90))
    assert pairs > 10 * len(sets)
    rows = [(7, 0, 0, 0, k, int(n[k]), k, sketches[k]) for k in range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["gram", "i", "j", "block", "node", "n", "root", "sketch"])
    found = [r for out in jaccard._near(90)(iter([batch])) for r in out.to_pylist()]
    assert len(found) == len({r["node"] for r in found}) <= len(sets)
    assert jaccard.forest(sets, np.arange(len(sets)), 90) == []


def test_a_forest_joins_what_links_join(monkeypatch):
    rng = np.random.default_rng(10)
    for fragment in (jaccard.FRAGMENT, 50):
        monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
        bases = [rng.integers(0, 2**63, int(rng.integers(20, 400))).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(90):
            base = bases[int(rng.integers(0, 4))]
            kept = base[rng.random(len(base)) > rng.random() * 0.12]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])))
        root = np.arange(90)
        root[:10] = 5
        links = {(a, b) for a in range(90) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}

        def parts(pairs):
            label = root.copy()
            for a, b in pairs:
                label[label == label[a]] = label[b]
            return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

        found = jaccard.forest(sets, root, 90)
        assert all((max(x), min(x)) in links for x in found)
        assert parts(found) == parts(links) and len(found) == len(set(root.tolist())) - len(parts(links)) < len(links)


def test_partial_overlaps():
    rng = np.random.default_rng(5)
    head, *members = (np.unique(rng.integers(0, 9000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(8))
    assert jaccard.partial_overlaps(head, members).tolist() == [len(np.intersect1d(head, b)) for b in members]


def test_one_of_each(docs, hard):
    for table in (docs, hard):
        kept = jaccard.one_of_each(table)
        assert kept.columns == table.columns
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        wordless = {r for r in rows if not shingles(r[1], 5)}
        groups = components_of(rows, 5, 80)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        worded = [r for r in got if shingles(r[1], 5)]
        assert len(worded) == len(groups)
        for group in groups:
            ids = [d for d, _ in group if d is not None]
            assert [r for r in worded if r in group and (not ids or r[0] == min(ids))] and len([r for r in worded if r in group]) == 1
        assert {r for r in got if not shingles(r[1], 5)} == wordless


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, PROSE, 7, "x"), (1, PROSE, 7, "a"), (2, PROSE, 8, "b"), (3, "other " * 9, 9, None)]
    for _ in range(2):
        kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __own long, __wanted string"))
        assert sorted(map(tuple, kept.collect())) == [(1, PROSE, 7, "a"), (3, "other " * 9, 9, None)]
        rows.reverse()


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 6000 + i) for i in range(80)] + [(6100, 6050), (9000, 6010)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    alone = {x for x in label if all(a == b for a, b in edges if x in (a, b))}
    for most in (joins.ROWS, 10):
        monkeypatch.setattr(joins, "ROWS", most)
        got = joins.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.root for r in got} == {x: r for x, r in label.items() if x not in alone}


def test_empty(empty):
    assert jaccard.linked(empty).count() == 0
    assert jaccard.one_of_each(empty).count() == 0
