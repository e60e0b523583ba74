"""The stages of the pipeline, each against a plain version on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ancestra.llm import quality, secrets, tokens
from tests.llm.conftest import SCHEMA, WORD
from tests.llm.test_links import components_of, shingles

TEXT = "A plain sentence about item {k} of the long list, and about {a} or {b}, and then some more words on it. "


@pytest.fixture(scope="module")
def table(spark, hard):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        text = "".join(TEXT.format(k=k, a=rng.integers(0, 999), b=rng.integers(0, 999)) for _ in range(1 + k % 9))
        rows.append((100 + k, text + ("password: hV7p!Qz2kW" if k % 7 == 0 else ""), "en", "abc"[k % 3], len(text), None, None, k))
    rows += [(200 + k, rows[k][1] + " end", *rows[k][2:]) for k in range(0, 60, 5)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).union(hard)


def keyed(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def plain_stages(spark, table):
    """(name, input rows, output rows) of each stage, the next one's input written in between."""
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        told = docs.collect()
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        yield name, told, rows
        docs = spark.createDataFrame(rows, docs.schema) if name != "packing" else docs


def test_each_stage(spark, table):
    encoder = tokens.Encoder(tokens.default_path())
    for name, told, rows in plain_stages(spark, table):
        if name == "quality_rules":
            frame = spark.createDataFrame(told, table.schema)
            good = Counter(r.doc_id for r in quality.judge(frame).where("kept").collect())
            assert Counter(r.doc_id for r in rows) == good and not keyed(rows) - keyed(told)
        elif name == "near_duplicates":
            pairs = [(r.doc_id, r.text) for r in told]
            groups = components_of(pairs, 5, 80)
            worded = [(r.doc_id, r.text) for r in rows if shingles(r.text, 5)]
            assert len(worded) == len(groups) and all(sum(w in g for w in worded) == 1 for g in groups)
            for g in groups:
                ids = [d for d, _ in g if d is not None]
                assert not ids or min(ids) in [d for d, t in worded if (d, t) in g]
        elif name == "secret_scans":
            assert keyed(rows) == Counter((r.doc_id, r.text and secrets.redacted(r.text)) for r in told)
            assert not any("hV7p!Qz2kW" in (r.text or "") for r in rows)
        elif name == "source_mixing":
            size = defaultdict(int)
            for r in told:
                size[r.source] += len(WORD.findall(r.text or ""))
            assert not set(keyed(rows)) - set(keyed(told))
            assert all(n <= 2 * keyed(told)[k] for k, n in keyed(rows).items())
            taken = sum(len(WORD.findall(r.text or "")) for r in rows)
            assert abs(taken - 1.5 * sum(size.values())) <= len(size) * max((len(WORD.findall(r.text or "")) for r in told), default=0)
        else:
            ids = Counter()
            for r in told:
                x = np.append(encoder.encode([r.text or ""])[0], 1).astype("<u4")
                ids[r.doc_id] += len(x)
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.length
            assert got == ids


def test_run_over_a_folder(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in rows) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in again)


def test_pieces_are_of_the_stages_texts(spark, table, tmp_path):
    """Packing's checksums are those of the ids of what mixing gave it."""
    told = table.where("doc_id between 100 and 120")
    encoder = tokens.Encoder(tokens.default_path())
    ids = {r.doc_id: np.append(encoder.encode([r.text])[0], 1).astype("<u4") for r in told.collect()}
    for r in corpus_pipeline.packing_stage(spark, told, "").collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_empty_tables(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = docs if name == "packing" else out
