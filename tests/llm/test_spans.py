import re

from ancestra.llm import pii, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x for _, _, x in sorted(found))


def test_secrets_base(docs, hard):
    for table in (docs, hard):
        told = table.collect()
        rows = secrets.find(table).collect()
        assert len(rows) == len(told)
        for r in rows:
            assert r.base_spans in [base_secrets(d.text or "") for d in told if d.doc_id == r.doc_id]


def test_guess_costs():
    easy = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "2019-03-04", "letmein2020", "abcabcabcabc", "Summer2024"]
    hard = ["Zx9$kQ27vLp", "hT7!pa0WqzR4", "b8f1e07c5d92"]
    assert max(map(secrets.guess_cost, easy)) < secrets.HARD <= min(map(secrets.guess_cost, hard))


def test_guess_cost_is_the_least_segmentation():
    for value in ("dogcat9", "Xpass1999q", "zzzabc1"):
        segments = list(secrets._segments(value))

        def best(j):
            if j == 0:
                return 0.0
            spans = [(i, secrets._brute(value[i:j])) for i in range(j)]
            return min(best(i) + secrets.SEGMENT + c for i, c in spans + [(i, c) for i, k, c in segments if k == j])

        assert abs(best(len(value)) - secrets.guess_cost(value)) < 1e-9


def test_hard_values_of_wider_contexts():
    text = "my pwd: Zx9$kQ27vLp, and passphrase: password123"
    assert [s[2] for s in secrets.spans(text)] == ["guess"]
    assert secrets.redacted(text) == "my pwd: [SECRET], and passphrase: password123"


def test_redact_keeps_columns(hard):
    out = secrets.redact(hard)
    assert out.schema == hard.schema
    rows = out.collect()
    assert len(rows) == hard.count()
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= digits(s) <= 19 and luhn(s)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= digits(s) <= 15),
]


def base_pii(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text) if ok(m[0]))


TRICKY = [
    "a@b.com@c.org a@b.c_d@e.f x@y..z u@v.w. @q.r é@b.co p@q.r.s..t",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9",
    "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6467 12  34 5 4539 1488 0343 6468",
    "+1 (555) 010-9999 +1-2 +12345678 ++49 30 123456. +1((((((",
]


def test_pii_base(spark, docs, hard):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), hard, extra):
        told = table.select("doc_id", "text").collect()
        rows = pii.find(table).collect()
        assert len(rows) == len(told)
        for r in rows:
            assert r.base_spans in [base_pii(d.text or "") for d in told if d.doc_id == r.doc_id]
            assert r.spans.startswith(r.base_spans)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words, please reach me at user{i}@mail{i}.org for more") for i in range(12)]
    rows += [(100 + i, f"please reach me at handle_{i}77x today") for i in range(3)]
    rows += [(200 + i, f"the year was {190000 + i} in that place") for i in range(12)]
    found = {r.doc_id: r.n_found for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[100 + i] == 1 for i in range(3))
    assert sum(n for d, n in found.items() if d < 100 or d >= 200) == 0


def test_empty(empty):
    assert secrets.find(empty).count() == 0
    assert secrets.redact(empty).count() == 0
    assert pii.find(empty).count() == 0
