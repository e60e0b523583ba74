import hashlib
import zlib
from collections import defaultdict

import numpy as np

from ancestra.llm import media, mixing
from tests.llm.conftest import WORD


def test_sound_round_trip(docs, hard):
    for table in (docs, hard):
        told = table.collect()
        rows = media.fingerprint(media.encode(table)).withColumn("feature", media.feature()).collect()
        assert len(rows) == len(told)
        by_payload = defaultdict(set)
        for r in rows:
            fits = []
            for d in told:
                if d.doc_id == r.doc_id:
                    raw = (d.text or "").encode()
                    full = media.payload(raw)
                    fits.append((len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in fits
            by_payload[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert all(len(v) == 1 for v in by_payload.values())


def test_wav_is_lossless():
    raw = bytes(range(256))
    assert media.from_wav(media.to_wav(raw)) == raw
    assert media.payload(b"") == bytes(64)
    assert len(media.payload(b"x" * 64)) == 64


def test_peaks_are_the_tone():
    """A pure tone peaks at its frequency in each full frame."""
    t = np.arange(64 * 10)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).reshape(-1, 64)
    found = media.peaks(tone, np.array([10]))
    assert (found[:-1, 1] == 20).all()
    codes, cuts = media.pairs(found, np.array([0, 10]))
    assert cuts.tolist() == [0, len(codes)]
    assert (np.diff(codes >> 20) >= 0).all()


def test_silence_has_no_peaks_and_a_chord_has_both():
    assert not media.peaks(np.full((5, 64), 128, np.uint8), np.array([5])).any()
    t = np.arange(64 * 8)
    chord = (128 + 50 * np.sin(2 * np.pi * 5 * t / media.FRAME) + 50 * np.sin(2 * np.pi * 30 * t / media.FRAME)).astype(np.uint8).reshape(-1, 64)
    assert (media.peaks(chord, np.array([8]))[:-1] == [5, 30]).all()


def test_fingerprints_are_of_the_brute_transform():
    """Each frame's transform by its definition, peaks and pairs one at a time."""
    rng = np.random.default_rng(3)
    t = np.arange(64 * 7)
    sound = (128 + rng.integers(-30, 30, 64 * 7) + 60 * np.sin(t * (0.2 + t / 4000))).clip(0, 255).astype(np.uint8)
    signal = np.append(sound.astype(float) - 128, np.zeros(64))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)
    peaks = []
    for f in range(7):
        x = signal[64 * f : 64 * f + 128] * window
        power = [abs(sum(v * np.exp(-2j * np.pi * k * i / 128) for i, v in enumerate(x))) for k in range(65)]
        row = []
        for a, b in media.BANDS:
            k = max(range(a, b), key=lambda k: power[k])
            top = power[k] > power[k - 1] and (k == 64 or power[k] > power[k + 1])
            row.append(k if top and power[k] > media.ABOVE * np.median(power[1:]) else 0)
        peaks.append(row)
    expected = [t << 20 | a << 13 | b << 6 | d for t in range(7) for d in range(1, media.REACH + 1) if t + d < 7 for a in peaks[t] for b in peaks[t + d] if a and b]
    found = media.peaks(sound.reshape(-1, 64), np.array([7]))
    assert found.tolist() == peaks and expected
    assert sorted(media.pairs(found, np.array([0, 7]))[0].tolist()) == sorted(expected)


def test_fingerprints_do_not_cross_sounds():
    blocks = np.random.default_rng(0).integers(0, 256, (6, 64)).astype(np.uint8)
    one = media.peaks(blocks[:3], np.array([3]))
    both = media.peaks(blocks, np.array([3, 6]))
    assert (both[:3] == one).all()


def check_mix(table):
    told = table.select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in told:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(size.values()), {}
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s] + 1e-9}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(2 * size[s] for s in over)
        free -= over
    rows = mixing.mix(table).collect()
    assert len(rows) == len(told)
    source_of = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in told}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == size[s]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], 2 * r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(table).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kept = mixing.apply(table)
    assert kept.columns == table.columns
    assert sum(len(WORD.findall(r.text or "")) for r in kept.select("text").collect()) == sum(r.taken for r in rows)


def test_mix(docs, hard):
    check_mix(docs)
    check_mix(hard)


def test_apply_keeps_clashing_columns(spark):
    rows = [(k, f"word {k} more", "ab"[k % 2], k, -k, f"t{k}") for k in range(40)]
    names = ["doc_id", "text", "source", "__hash", "__key", "__time"]
    told = {r[0]: r for r in rows}
    out = mixing.apply(spark.createDataFrame(rows, names)).collect()
    assert out and all(tuple(r) == told[r.doc_id] for r in out)


def test_rows_of_one_doc_id_are_taken_apart(spark):
    """Different texts under one doc_id, or none, do not share a threshold."""
    rows = [(None if k % 2 else 7, f"words of row {k}", "a") for k in range(300)] + [(1, "x y z " * 300, "b")]
    check = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1800 for r in check)
    assert any(r["source_size"] == 1200 and abs(r["sum(taken)"] - r["max(target)"]) <= 8 for r in check)


def test_many_sources_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    check_mix(docs)


def test_empty(empty):
    assert media.fingerprint(media.encode(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.apply(empty).count() == 0
