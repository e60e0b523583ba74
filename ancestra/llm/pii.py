"""Personal data by patterns, and by contexts that the patterns' finds teach.

Four patterns find email addresses, IP addresses, payment cards and phone
numbers. They are the seeds of a bootstrap: the words before a find, or before an
identifier-like token, are its lexical pattern, and patterns and tokens form a graph. A pattern
scores by the scores of its distinct tokens, a token by its best pattern, in
turn for some rounds; seeds keep score one. Tokens that follow a pattern of high
score and are in no base span are found as well.

All of it is DataFrame operations. Positions come from splitting a text at the
matches: gaps and matches alternate, so their lengths add up to each start; the
sums are made in blocks, so the work stays in proportion to the matches. Which
tokens overlap a find is told by running extremes over a text's spans in order.

By definition a context is the last two words of the CONTEXT characters before,
as far back as the last three finds of the pattern; of a longer word it has the
end. A token has SHORTEST to LONGEST characters; longer and shorter runs are no
identifiers here, but the base patterns find them at any length.

Defined cases: a null or empty text has no spans; repeated rows and doc_ids are
searched row by row (each counts in the scores once a distinct token); positions
count code points; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.llm.storage import checkpointed
from ancestra.operators.joins import looked_up

KINDS = ("email", "ip", "card", "phone")

# Patterns for Java. Each matches as the plain pattern does, but starts only where
# a run of its characters starts (or the last match ended), never gives back what
# it took, and repeats single characters, so long runs cost neither squared time
# nor a deep stack.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9 -](?<![ -][ -]))*(?<![ -])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Runs with a digit, the tokens that contexts are learned for.
TOKEN = r"(?<![A-Za-z0-9_.@+-])[A-Za-z_.@+-]*+[0-9][A-Za-z0-9_.@+-]*+"
SHORTEST, LONGEST = 6, 64
CONTEXT = 60

#: Lengths that are added up together.
SUMMED = 256

ROUNDS = 3
#: Score from which a pattern finds, and distinct tokens that it must have.
CONFIDENT, SUPPORT = 0.7, 5

_SPANS = "array<struct<start:bigint,end:bigint,text:string,gap:string>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Before each item the sum of those before it: within blocks, and of the blocks.

    An array that grows by one is copied each time, so none grows beyond a block's
    length or the number of blocks."""

    def sums(values: Column, first: Column, indices: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, i: F.struct((acc["at"] + values[i]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(indices, zero, step, lambda acc: acc["out"])

    def inside(n: Column, k: Column) -> Column:
        return F.sequence(k * SUMMED, F.least((k + 1) * SUMMED, n) - 1)

    n = F.size(sizes)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / SUMMED).cast("int"))
    totals = F.transform(blocks, lambda k: F.aggregate(inside(n, k), F.lit(0).cast("long"), lambda acc, i: acc + sizes[i]))
    starts = _let(totals, lambda t: sums(t, F.lit(0).cast("long"), F.sequence(F.lit(0), F.size(t) - 1)))
    return _let(starts, lambda s: F.flatten(F.transform(blocks, lambda k: sums(sizes, s[k], inside(n, k)))))


def _placed(found: str, gaps: str) -> Column:
    """Matches with their bounds, and the end of the text before each."""
    f, g = F.col(found), F.col(gaps)

    def before(i: Column) -> Column:
        earlier = [F.when(i >= k, F.concat(F.right(g[i - k], F.lit(CONTEXT)), F.right(f[i - k], F.lit(CONTEXT)))).otherwise("") for k in (3, 2, 1)]
        return F.right(F.concat(*earlier, g[i]), F.lit(CONTEXT))

    def span(at: Column, i: Column) -> Column:
        start = at[i] + F.length(g[i])
        return F.struct(start.alias("start"), (start + F.length(f[i])).alias("end"), f[i].alias("text"), before(i).alias("gap"))

    indices = F.sequence(F.lit(0), F.size(f) - 1)
    sizes = F.transform(indices, lambda i: (F.length(g[i]) + F.length(f[i])).cast("long"))
    every = _let(_let(sizes, _running), lambda at: F.transform(indices, lambda i: span(at, i)))
    return F.when(F.size(f) > 0, every).otherwise(F.array().cast(_SPANS))


def _luhn(number: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    digits = F.reverse(F.regexp_replace(number, "[ -]", ""))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(F.regexp_replace(x, "[ -]", "")).between(16, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _with_spans(rows: DataFrame, name: str, pattern: str, needs: str | None, keep) -> DataFrame:
    """Add column name: the placed matches of a pattern that keep allows."""
    found = _matches(F.col("text"), pattern)
    if needs:
        found = F.when(F.contains("text", F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__found", found)
    some = F.exists("__found", keep)
    rows = rows.withColumn("__gaps", F.when(some, F.split("text", pattern, -1)))
    placed = F.when(F.col("__gaps").isNotNull(), F.filter(_placed("__found", "__gaps"), lambda s: keep(s["text"])))
    return rows.withColumn(name, F.coalesce(placed, F.array().cast(_SPANS))).drop("__found", "__gaps")


def _context(gap: Column) -> Column:
    """The last two words before a token, digits alike; null if there is none."""
    words = F.regexp_extract(gap, r"((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)$", 1)
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(words, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")))
    return F.when(F.length(plain) > 0, plain)


def searched(docs: DataFrame) -> DataFrame:
    """row, doc_id, the base spans by kind, and the finds (as seeds) and tokens with their contexts, of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = _with_spans(rows, kind, PATTERNS[kind], _NEEDS.get(kind), partial(_valid, kind))
    rows = _with_spans(rows, "tokens", TOKEN, None, lambda x: F.length(x).between(SHORTEST, LONGEST))

    def nodes(spans: Column, seed: bool) -> Column:
        return F.transform(spans, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("token"), _context(t["gap"]).alias("pattern"), F.lit(seed).alias("seed")))

    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *bare, F.concat(nodes(F.concat(*KINDS), True), nodes(F.col("tokens"), False)).alias("tokens"))


def nodes(rows: DataFrame) -> DataFrame:
    """row, start, end, token, pattern and seed of the finds and tokens that have a context:
    tokens that overlap no find, and finds that no other find holds.

    Of the spans of a text in order the finds' greatest end so far and the next
    find's start tell; a piece of a find has a piece of it as its context."""
    spans = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    forth = W.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("seed").desc())
    back = W.partitionBy("row").orderBy(F.col("start").desc(), "end", "seed")
    before = F.max(F.when(F.col("seed"), F.col("end"))).over(forth.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("seed"), F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("before", F.coalesce(before, F.lit(-1))).withColumn("after", F.coalesce(after, F.col("end")))
    free = F.when(F.col("seed"), F.col("before") < F.col("end")).otherwise((F.col("before") <= F.col("start")) & (F.col("after") >= F.col("end")))
    return marked.where(free & F.col("pattern").isNotNull()).drop("before", "after")


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns that find, with their scores, from the graph of patterns and tokens.

    A pattern's score is the mean of its distinct tokens' scores, drawn to zero by
    one token's weight; a token's is that of its best pattern, halved, unless it is
    a seed. A pattern or token of very many edges is looked up by broadcast."""
    edges = checkpointed(found.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    total = edges.count()
    scored = edges.withColumn("value", F.col("seed").cast("double"))
    for _ in range(rounds):
        by_pattern = scored.groupBy("pattern").agg((F.sum("value") / (F.count("*") + 1)).alias("score"), F.count("*").alias("n"))
        by_token = looked_up(edges, by_pattern, "pattern", total).groupBy("token").agg(F.max("score").alias("best"), F.max("seed").alias("known"), F.count("*").alias("n"))
        value = F.when(F.col("known"), 1.0).otherwise(F.col("best") / 2)
        scored = checkpointed(looked_up(edges, by_token.select("token", value.alias("value"), "n"), "token", total))
    final = scored.groupBy("pattern").agg((F.sum("value") / (F.count("*") + 1)).alias("score"), F.count("*").alias("held"))
    return final.where((F.col("score") >= CONFIDENT) & (F.col("held") >= SUPPORT))


def _written(spans: Column, kind: str) -> Column:
    return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, counts by kind, and the spans as kind:start:end of each row."""
    rows = checkpointed(searched(docs))
    found = checkpointed(nodes(rows))
    good = checkpointed(confident_patterns(found, rounds)).select("pattern")
    new = found.where(~F.col("seed")).select("row", "start", "end", "pattern")
    times = new.groupBy("pattern").agg(F.count("*").alias("n")).join(good, "pattern")
    picked = looked_up(new, times, "pattern", new.count())
    found = picked.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    whole = rows.join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    base = F.concat(*(_written(F.col(k), k) for k in KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "found")]
    return whole.select("doc_id", *counts, F.array_join(base, ",").alias("base_spans"), F.array_join(F.concat(base, _written(F.col("found"), "found")), ",").alias("spans"))
