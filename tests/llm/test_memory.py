import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ancestra.llm import packing, quality, scan, secrets, tokens


def held():
    """MB that this process holds."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_memory_of_a_task_goes_back():
    """Freed memory below a piece that is still in use stays with the process if it is not given back."""
    left = []

    def task(batches):
        parts = [np.ones(2500) for _ in range(10_000)]
        left.append(parts[-1])
        yield from batches

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    before = held()
    plain = [b.to_pydict() for b in task(iter([batch]))]
    kept = held() - before
    assert [b.to_pydict() for b in scan.giving_back(task)(iter([batch]))] == plain == [{"x": [1, 2]}]
    assert scan.giving_back(task).__name__ == "task"
    assert held() - before < max(kept, 100) / 2


@pytest.fixture(scope="module")
def large():
    """One batch of 16 MB."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"Some words of {a} and more about {b}." for a, b in rng.integers(0, 3000, (60, 2))) for _ in range(7000)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])


def peak(make):
    """MB that making a result, which is let go, takes at most, and that stay."""
    tracemalloc.start()
    try:
        for _ in make():
            pass
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return most / 1e6, now / 1e6


def test_slices_have_all_rows(large, monkeypatch):
    monkeypatch.setattr(scan, "SLICE", 100_000)
    parts = list(scan.slices([large, large.slice(0, 0), large.slice(5, 1)]))
    assert max(p.nbytes for p in parts) < 200_000
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([large, large.slice(5, 1)]))
    assert [p.num_rows for p in scan.slices([large.slice(0, 3)], limit=1)] == [1, 1, 1]


def test_packing_holds_little_of_a_large_batch(large, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    path = tokens.default_path()
    tokens.encoder(path).encode([large.column(1)[0].as_py()])
    sent = []
    most, _ = peak(lambda: (sent.append((b.num_rows, b.nbytes)) for b in packing._packer(2048, 1, path)(iter([large]))))
    assert sum(n for n, _ in sent) >= large.num_rows and max(size for _, size in sent) < 4e6
    assert most < 60


def test_powers_for_long_texts_are_let_go():
    long = np.arange(3 << 20, dtype=np.uint64)

    def hashed():
        yield scan.run_hash(scan.prefix_hash(long, 5), np.array([0]), np.array([9]), 5)

    assert peak(hashed)[1] < 20


def test_stages_send_small_batches(large, monkeypatch):
    docs = SimpleNamespace(schema=None, mapInArrow=lambda task, schema: task)
    every = list(range(3 ** len(quality.RULES)))
    monkeypatch.setattr(quality, "counted", lambda docs: docs)
    monkeypatch.setattr(quality, "_fitted", lambda docs: (SimpleNamespace(posterior=np.ones_like, threshold=0.5), every))
    whole = pa.Table.from_batches([large])
    for task in (secrets.redact(docs), quality.keep(docs)):
        sent = list(task(iter([large])))
        assert max(b.nbytes for b in sent) < 2 * scan.SLICE
        kept = pa.Table.from_batches(sent)
        assert kept.num_rows and kept.equals(whole.take(kept["doc_id"]))
