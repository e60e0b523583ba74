"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes good, bad, or abstains.
Expectation-maximisation over the counts of distinct vote patterns (at most
3 ** 9, whatever the size of the corpus) estimates how often
each rule is right, and the posterior probability of good quality decides.

Defined cases: a null or empty text has no words, so base_failed is true and
kept false; repeated rows and repeated doc_ids are judged row by row; an empty
table gives an empty result; other columns of the input are ignored by
``judge`` and passed through unchanged by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.llm import scan
from ancestra.llm.storage import checkpointed

BAD, ABSTAIN, GOOD = 0, 1, 2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_letters", "n_upper", "n_stops", "n_runs")

#: The characters that n_symbols counts.
SYMBOLS = b"#*$%&|<>"

WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # first bytes of letters beyond ASCII; a lead byte counts once
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more in their document; which are not the first."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out_twice, out_later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    out_twice[order], out_later[order] = twice, same
    return out_twice, out_later


def _line_counts(texts: scan.Texts, found: scan.Words, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier one, by document."""
    n = len(texts.data)
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.union1d(texts.bounds[:-1][texts.bounds[:-1] < n], breaks + 1)
    starts = starts[starts < n]
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, n)[at], texts.bounds[np.searchsorted(texts.bounds, starts, "right")])
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(texts.bounds, starts, "right") - 1
    _, later = _repeats(doc, scan.run_hash(prefix, starts, ends, 0))
    return np.bincount(doc, minlength=texts.n), np.bincount(doc[later], minlength=texts.n)




def count(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column, as int64 arrays."""
    parts: list[np.ndarray] = []
    for texts in scan.blocks(column):
        found = scan.words(texts)
        prefix = scan.prefix_hash(scan.byte_values(texts.data, 0), 0)
        hashes = scan.run_hash(prefix, found.starts, found.ends, 0)
        out = np.zeros((texts.n, len(COUNTS)), np.int64)
        out[:, 0] = np.diff(found.bounds)
        first_byte = (texts.data & 0xC0) != 0x80
        out[:, 1] = _per_doc(first_byte & ~scan.SPACE[texts.data], texts.bounds)
        out[:, 2] = _per_doc(_SYMBOL[texts.data], texts.bounds)
        out[:, 5], out[:, 3] = _line_counts(texts, found, prefix)
        at = scan.windows(found.bounds, WINDOW)
        if len(at):
            grams = scan.prefix_hash(hashes, 1)
            doc_of_word = found.doc
            twice, _ = _repeats(doc_of_word[at], scan.run_hash(grams, at, at + WINDOW, 1))
            inside = scan.covered(at[twice], WINDOW, len(hashes))
            out[:, 4] = np.bincount(doc_of_word[inside], minlength=texts.n)
        letters = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(_LETTER[texts.data], out=letters[1:])
        alpha = letters[found.ends] > letters[found.starts]
        out[:, 6] = _per_doc(alpha, found.bounds)
        out[:, 7] = letters[texts.bounds[1:]] - letters[texts.bounds[:-1]]
        out[:, 8] = _per_doc(_UPPER[texts.data], texts.bounds)
        out[:, 9] = _per_doc(_STOP[texts.data[found.ends - 1]], found.bounds) if len(hashes) else 0
        doubled = np.zeros(len(texts.data), bool)
        doubled[1:] = (texts.data[1:] == texts.data[:-1]) & _MARK[texts.data[1:]]
        doubled[texts.bounds[texts.bounds < len(doubled)]] = False
        out[:, 10] = _per_doc(doubled, texts.bounds)
        parts.append(out)
    table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
    return {name: np.ascontiguousarray(table[:, i]) for i, name in enumerate(COUNTS)}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def _between(x: np.ndarray, bad_low: float, good_low: float, good_high: float, bad_high: float) -> np.ndarray:
    vote = np.full(len(x), ABSTAIN)
    vote[(x >= good_low) & (x <= good_high)] = GOOD
    vote[(x < bad_low) | (x > bad_high)] = BAD
    return vote


#: name -> (numerator, denominator, bad below, good from, good to, bad above)
RULES: dict[str, tuple[str, str, float, float, float, float]] = {
    "length": ("n_words", "", 12, 40, np.inf, np.inf),
    "word_length": ("word_chars", "n_words", 2.5, 3.5, 8, 12),
    "symbols": ("n_symbols", "n_words", -1, 0, 0.02, 0.2),
    "doubled_marks": ("n_runs", "n_words", -1, 0, 0.04, 0.3),
    "repeated_lines": ("n_dup_lines", "n_lines", -1, 0, 0.05, 0.3),
    "repeated_words": ("n_repeat_words", "n_words", -1, 0, 0.02, 0.12),
    "letters": ("n_alpha_words", "n_words", 0.65, 0.9, 1, 1),
    "capitals": ("n_upper", "n_letters", -1, 0, 0.2, 0.6),
    "sentences": ("n_stops", "n_words", 0.005, 0.02, 0.25, 0.5),
}


def vote(c: dict[str, np.ndarray]) -> np.ndarray:
    """One column of votes a rule; 0/0 lets a rule abstain."""
    out = []
    for top, under, *limits in RULES.values():
        d = c[under] if under else np.ones(len(c[top]))
        v = _between(c[top] / np.maximum(d, 1), *limits)
        out.append(np.where(d == 0, ABSTAIN, v))
    return np.stack(out, 1) if len(c["n_words"]) else np.zeros((0, len(RULES)), int)


def pattern(votes: np.ndarray) -> np.ndarray:
    """The votes of a document as one integer, a digit of base three a rule."""
    return votes @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


#: Imagined votes (bad, good) a rule on bad documents and on good ones, and imagined
#: documents (bad, good).
PRIOR_VOTES = ((3, 7), (1, 49))
PRIOR_DOCUMENTS = (2, 18)


@dataclass
class QualityModel:
    """Estimated prior and, by class and vote, each rule's chances.

    ``chances[0]`` holds them for bad documents, ``chances[1]`` for good ones,
    one row a rule and one column a vote (bad, abstain, good); the accuracies
    are ``chances[0][:, BAD]`` and ``chances[1][:, GOOD]`` among votes cast."""

    prior: float = 0.9
    chances: np.ndarray = field(default_factory=lambda: np.tile(np.array([[0.27, 0.1, 0.63], [0.018, 0.1, 0.882]])[:, None], (1, len(RULES), 1)))
    threshold: float = 0.5

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good; an abstention says nothing."""
        votes = _digits(patterns)
        weight = np.log(self.chances[1]) - np.log(self.chances[0])
        weight[:, ABSTAIN] = 0
        score = np.log(self.prior / (1 - self.prior)) + weight[np.arange(len(RULES)), votes].sum(1)
        return 1 / (1 + np.exp(-score))


def _digits(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(len(RULES))) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, threshold: float = 0.5) -> QualityModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Votes that are imagined beside those cast (PRIOR_VOTES, PRIOR_DOCUMENTS) say
    which class is which and keep a rule that seldom speaks from deciding alone;
    they weigh less the more documents there are. The start is what they say."""
    model = QualityModel(threshold=threshold)
    patterns, counts = np.asarray(patterns, np.int64), np.asarray(counts, float)
    if not len(patterns):
        return model
    votes = _digits(patterns)
    for _ in range(rounds):
        good = model.posterior(patterns)
        for k, share in enumerate((1 - good, good)):
            seen = np.stack([((votes == v) * (share * counts)[:, None]).sum(0) for v in range(3)], 1)
            wrong, right = PRIOR_VOTES[k]
            bad = (seen[:, BAD] + wrong) / (seen[:, BAD] + seen[:, GOOD] + wrong + right)
            rest = (seen[:, ABSTAIN] + 1) / (seen.sum(1) + 3)
            model.chances[k] = np.stack([bad * (1 - rest), rest, (1 - bad) * (1 - rest)], 1)
        few, many = PRIOR_DOCUMENTS
        model.prior = float(((good * counts).sum() + many) / (counts.sum() + few + many))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = count(batch.column(1))
        columns = [batch.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(base_failed(c)), pa.array(pattern(vote(c)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "votes"])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and the vote pattern of each row."""
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, votes long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan.giving_back(_counted), schema)


def _fitted(rows: DataFrame, **options) -> tuple[QualityModel, list]:
    """Only documents that pass the base take part; at most 3 ** rules patterns reach the driver."""
    found = rows.where(~F.col("base_failed")).groupBy("votes").count().collect()
    return fit(np.array([r[0] for r in found]), np.array([r[1] for r in found]), **options), [r[0] for r in found]


def judge(docs: DataFrame, **options) -> DataFrame:
    """Counts and verdict of each row: base_failed, p_good (null where the base failed), kept."""
    rows = checkpointed(counted(docs))
    model, patterns = _fitted(rows, **options)
    p = model.posterior(np.array(patterns, np.int64)) if patterns else np.zeros(0)
    table = docs.sparkSession.createDataFrame([(int(k), float(v)) for k, v in zip(patterns, p)], "pattern long, chance double")
    judged = rows.join(F.broadcast(table), F.col("votes") == F.col("pattern"), "left")
    judged = judged.select("doc_id", *COUNTS, "base_failed", "votes", F.when(~F.col("base_failed"), F.col("chance")).alias("p_good"))
    return judged.withColumn("kept", F.coalesce(F.col("p_good") >= model.threshold, F.lit(False)))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, unchanged, with all their columns.

    Each text is counted twice, which is cheaper than a shuffle of texts to their votes."""
    model, patterns = _fitted(counted(docs), **options)
    passed = np.sort(np.array([k for k, v in zip(patterns, model.posterior(np.array(patterns, np.int64)) if patterns else []) if v >= model.threshold], np.int64))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.slices(batches):
            c = count(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(~base_failed(c) & np.isin(pattern(vote(c)), passed)))

    return docs.mapInArrow(scan.giving_back(kept), docs.schema)
