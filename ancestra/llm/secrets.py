"""Secrets in texts: patterns, and values that are hard to guess.

Three patterns find assignments, access keys and long hexadecimal runs. Beside
them, the value after any word of a credential context, also one that is part of
a name (DB_PASS, dbPassword), is cut into words,
dates, repeats, keyboard walks and brute-force spans at the least total cost;
the sum is the number of guesses, as a power of ten, that an attacker needs who
tries easy segments first. Words cost by their place in a list of common
passwords and, after it, in the vocabulary of a public tokenizer, which is in
order of frequency. A value is a secret, too, if its cost is beyond a threshold
in all and by character: what reads as words and dates, a path or a name, is
long but cheap for its length.

Defined cases: a null or empty text has no spans; repeated rows and doc_ids are
scanned row by row; positions count code points; an empty table gives an empty
result; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import scan
from ancestra.llm.tokens import default_path

KINDS = ("assign", "access", "hex", "guess")

#: The three patterns of the base.
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: The wider context: a credential word, a joint, and the value. A word starts after
#: a non-letter or where camel case turns, so parts of names like DB_PASS count.
_WORD = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|client)[_-]?(?:key|id|secret))"
_TURN = r"(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
WORD = re.compile(_WORD)
CONTEXT = re.compile(rf"""{_TURN}(?={_WORD}["']?(?P<joint>\x20*(?::=|=>|[:=])\x20*|\x20(?i:is|was)\x20|\x20)["']?(?P<value>))""")
VALUE = re.compile(r"""[^\s"'<>,;]+""")
_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key", "client")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: log10 of the guesses from which a value counts as a secret, in all and a character.
HARD, DENSE = 10.0, 1.0

#: Longest value whose cost is remembered.
REMEMBERED = 128

#: Shortest and longest word of the vocabulary that counts.
WORD_SIZES = (3, 20)

#: Common words of passwords, most common first; the place is the cost.
COMMON = """password 123456 qwerty letmein welcome admin monkey dragon master login hello secret
love summer winter spring autumn shadow sunshine princess football baseball superman batman test
user guest default change changeme access root temp pass word key token example sample demo money
star blue red green black white house home cat dog happy family friend world computer internet server
system data cloud dev prod stage local public private service client account name mail email web site
app the and for with you this that from have not are was all new one two three four five six seven
eight nine ten january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday""".split()

#: Rows of a keyboard and the two alphabets that hands walk along.
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "01234567890", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")

#: Look-alikes that stand for letters.
_PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")

_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_STEPS = {a + b for walk in WALKS for row in (walk, walk[::-1]) for a, b in zip(row, row[1:])}


@lru_cache(maxsize=2)
def ranks(path: str = "") -> dict[str, int]:
    """Place of each word: common passwords, then the words of a tokenizer's vocabulary by id."""
    ids = json.loads(Path(path or default_path()).read_bytes())["model"]["vocab"]
    words = [t.lstrip("Ġ").lower() for t in sorted(ids, key=ids.get)]
    out: dict[str, int] = {}
    for w in (*COMMON, *(w for w in words if w.isascii() and w.isalpha() and WORD_SIZES[0] <= len(w) <= WORD_SIZES[1])):
        out.setdefault(w, len(out) + 1)
    return out


#: Kinds of characters and how many of each there are to guess from; JOINTS stand between words.
JOINTS = "-_./:@ "
_SIZES = (10, 26, 26, len(JOINTS), 33)
_CHOICES = [0.0, *(math.log10(sum(n for k, n in enumerate(_SIZES) if mask >> k & 1)) for mask in range(1, 32))]

#: log10 of the guesses where a segment ends and of what kind the next one is.
SEGMENT = 0.5


def _kind(c: str) -> int:
    """The kind of a character, as a bit."""
    if c in JOINTS:
        return 8
    if not c.isascii():
        return 2 if c.isalpha() else 16
    return 1 if c.isdigit() else 2 if c.islower() else 4 if c.isupper() else 16


def _brute(value: str) -> float:
    """log10 of the spans of this length of the kinds of characters that the value has."""
    mask = 0
    for c in value:
        mask |= _kind(c)
    return len(value) * _CHOICES[mask]


def _segments(value: str, path: str = "") -> Iterator[tuple[int, int, float]]:
    """Segments (start, end, cost) other than brute force."""
    rank_of = ranks(path)
    low = value.lower()
    plain = low.translate(_PLAIN)
    n = len(value)
    for i in range(n):
        for j in range(i + WORD_SIZES[0], min(n, i + WORD_SIZES[1]) + 1):
            rank = rank_of.get(low[i:j]) or rank_of.get(plain[i:j])
            if rank:
                odd = sum(a != b for a, b in zip(value[i:j], low[i:j])) + sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                yield i, j, math.log10(rank + 1) + 0.3 * min(odd, 6)
    for m in _DATE.finditer(value):
        yield m.start(), m.end(), 2.1 if m.end() - m.start() == 4 else 4.6
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and low[j - 1 : j + 1] in _STEPS:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(47 * (j - i))
        i = max(j - 1, i + 1)
    for unit in range(1, 9):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            times = (j - i) // unit
            if times >= (3 if unit == 1 else 2):
                yield i, i + times * unit, _brute(value[i : i + unit]) + math.log10(times)
                i = j - unit + 1
            else:
                i += 1


def least_cost(value: str, path: str = "") -> float:
    """log10 of the guesses for a value: its cheapest segmentation."""
    n = len(value)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _segments(value, path):
        by_end.setdefault(j, []).append((i, cost))
    best = [0.0] * (n + 1)
    brute = [math.inf] * 32  # the least cost so far that ends in a brute-force span of these kinds
    for j in range(1, n + 1):
        kind = _kind(value[j - 1])
        for mask in range(1, 32):
            brute[mask] = min(brute[mask], best[j - 1] + SEGMENT) + _CHOICES[mask] if mask & kind else math.inf
        best[j] = min(min(brute), *(best[i] + SEGMENT + cost for i, cost in by_end.get(j, ()))) if j in by_end else min(brute)
    return best[n]


_remembered = lru_cache(maxsize=4096)(least_cost)


def guess_cost(value: str, path: str = "") -> float:
    """least_cost, remembered for values that are not long."""
    return (_remembered if len(value) <= REMEMBERED else least_cost)(value, path)


Span = tuple[int, int, str]


def _guessed(text: str, hard: float) -> Iterator[tuple[int, int]]:
    """Bounds of hard values after credential words.

    Contexts are looked for at every place, within values, too, but a run of
    characters is judged once, from its first context on: what is left of an
    easy value is no harder. After a joint the cost alone decides; where only a
    space stands, a run of letters alone is the next word of a sentence."""
    judged = 0
    for m in CONTEXT.finditer(text):
        run = VALUE.match(text, m.start("value")) if m.start("value") >= judged else None
        if not run:
            continue
        judged = run.end()
        value = run[0].rstrip(".!?:)")
        if m["joint"] == " " and value.isalpha() or WORD.fullmatch(value):
            continue
        if guess_cost(value) >= max(hard, DENSE * len(value)):
            yield run.start(), run.start() + len(value)


def spans(text: str, hard: float = HARD) -> list[Span]:
    """All spans (start, end, kind), by start and then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        out += [(a, b, "guess") for a, b in _guessed(text, hard)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_spans", "spans"]
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            all_spans = spans(text or "")
            count = [sum(s[2] == k for s in all_spans) for k in KINDS]
            rows.append((*count, written([s for s in all_spans if s[2] != "guess"]), written(all_spans)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, and the spans as kind:start:end of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_spans string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret replaced by a mark, n_chars (if there) made anew."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.slices(batches):
            k = batch.schema.get_field_index("text")
            texts = [t if t is None else redacted(t) for t in batch.column(k).to_pylist()]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0:
                sizes = [None if t is None else len(t) for t in texts]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(scan.giving_back(changed), docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
