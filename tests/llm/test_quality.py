import numpy as np

from ancestra.llm import quality
from tests.llm.conftest import WORD


def counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_match_brute_force(docs, hard):
    for table in (docs, hard):
        told = {(r.doc_id, r.text): r for r in table.collect()}
        out = quality.judge(table).collect()
        assert len(out) == table.count()
        for r in out:
            options = [counts(t) for (d, t) in told if d == r.doc_id]
            assert tuple(r[n] for n in NAMES) in options
            n, repeated = r.n_words, r.n_repeat_words
            assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
            assert not (r.base_failed and r.kept)


def test_keep_agrees_with_judge(docs):
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == good


def test_labelled_documents(spark, sf):
    """The estimates need some thousand documents; these are ten thousand."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.98
    assert np.mean(junk) < 0.2


def test_estimates_find_a_bad_rule():
    rng = np.random.default_rng(0)
    good = rng.random(5000) < 0.8
    votes = np.where(rng.random((5000, len(quality.RULES))) < 0.95, np.where(good[:, None], quality.GOOD, quality.BAD), quality.ABSTAIN)
    votes[:, 0] = quality.GOOD
    patterns, n = np.unique(quality.pattern(votes), return_counts=True)
    model = quality.fit(patterns, n)
    assert abs(model.prior - good.mean()) < 0.05
    assert ((model.posterior(quality.pattern(votes)) > 0.5) == good).mean() > 0.99
    assert model.chances[0][0, quality.BAD] < model.chances[0][1, quality.BAD]


def test_empty(empty):
    assert quality.judge(empty).count() == 0
    assert quality.keep(empty).count() == 0
