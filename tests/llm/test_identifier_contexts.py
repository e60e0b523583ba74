import time

import pytest
from pyspark.sql import functions as F

from ancestra.llm import pii


def luhn_card(i):
    head = f"4539{i:011d}"
    total = sum(d if k % 2 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(map(int, head[::-1])))
    card = head + str(-total % 10)
    return " ".join(card[k : k + 4] for k in range(0, 16, 4))


@pytest.mark.parametrize(
    "seed",
    [lambda i: f"+1 ({17 + i:03d}) 555-77{i:02d}", luhn_card, lambda i: f"{'abcdefghijkl'[i]}.person@mail.org", lambda i: f"10.0.0.{i}"],
    ids=["phone", "card", "email", "ip"],
)
def test_each_kind_of_find_teaches_its_context(spark, seed):
    rows = [(i, f"you may always reach me at {seed(i)} all day") for i in range(12)]
    rows += [(100 + i, f"you may always reach me at handle_{i}77x today") for i in range(3)]
    rows += [(200 + i, f"the lot was number item_{i}88y in that place") for i in range(12)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.base_spans for d, r in found.items() if d < 100)
    assert {d for d, r in found.items() if r.n_found} == {100, 101, 102}


def test_contexts_are_words_before_the_whole_find(spark):
    text = "room 12 call +1 (017) 555-7713 or 3 mail a.b@c.org"
    rows = pii.nodes(pii.searched(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert {(t.token, t.pattern) for t in rows if t.seed} == {("+1 (017) 555-7713", "0 call"), ("a.b@c.org", "0 mail")}


def test_positions_of_many_matches_in_one_text(spark, monkeypatch):
    """Texts of 16000 and 160000 tokens take time in proportion, and each token its place."""
    seconds = {}
    for n in (16000, 160000):
        text = " ".join(f"item_{k:06d}x" for k in range(n)) + " a.b@c.org"
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = pii.searched(rows).select("email", F.size("tokens"), F.col("tokens")[n - 5]).first()
        seconds[n] = time.time() - began
        assert got[0][0].start == 13 * n and got[1] == n + 1
        assert got[2].start == 13 * (n - 6) and got[2].token == f"item_{n - 6:06d}x"
    assert seconds[160000] < 60 and seconds[160000] < 30 * max(seconds[16000], 0.5)


def test_overlaps_of_spans(spark):
    text = "see 10.0.0.1x77 call +49 4539148803436467 or id_4539148803436467z end"
    found = pii.searched(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base = [(s.start, s.end) for k in pii.KINDS for s in found[k]]
    got = {(r.start, r.end) for r in pii.nodes(spark.createDataFrame([found], pii.searched(spark.createDataFrame([(1, text)], "doc_id long, text string")).schema)).collect() if not r.seed}
    tokens = {(t.start, t.end) for t in found.tokens if not t.seed and t.pattern}
    assert got == {(a, b) for a, b in tokens if not any(x < b and y > a for x, y in base)}
