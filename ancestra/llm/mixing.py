"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and by the leading bits of a hash of doc_id and text. The
bucket in which a source's running sum crosses its budget is refined by the next
bits, level by level, and nothing else is looked at again. So the threshold that
meets the budget is found without sorting documents, and one comparison with it
says whether a document is taken. Whole copies come first: a source whose target
is above its size is taken once in full, and the budget concerns the second copy.

All of it is DataFrame operations. Defined cases: a null or empty text has size
0; a null source is a source of its own, the last; rows with one doc_id and text
in one source share their hash and are taken together; an empty table gives an empty
result; other columns are ignored, or kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.llm.storage import checkpointed, free_name

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2

#: Bits of the hash, and bits that each level looks at.
HASH_BITS = 60
LEVEL_BITS = 12

_WORD = "[^\\x20\\x09-\\x0D]+"


#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
FEW_SOURCES = 10_000


def _few(sources: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(sources) if few else sources


def source_key(source: str = "source") -> Column:
    """A key that is never null and sorts like the sources by code point, null last."""
    s = F.col(source).cast("string")
    return F.when(s.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), s))


def document_hash(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, key of the source, size in words and hash of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"), size.alias("size"), document_hash(seed).alias("hash"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """key, source_size and target of each source.

    With sources in the order of cap by weight, the common level is the greatest
    of those that follow if the first k are held at their caps."""
    by_source = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    held = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    filled = W.orderBy(F.col("most") / F.col("weight"), "key")
    everywhere = W.partitionBy()
    level = (F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("most").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    levels = held.withColumn("level", level).withColumn("level", F.max("level").over(everywhere))
    return levels.select("key", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, aims: DataFrame, few: bool = False) -> DataFrame:
    """What is taken of each source: whole copies, and one more of documents whose
    hash is below ``threshold``, and of those at it if ``at`` is true."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = aims.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.select("key", "size", "hash").join(_few(state.select("key", "prefix", "budget"), few), "key").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
        upto = F.sum("size").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        crossing = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        edge = crossing.groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "upto"), "bucket").alias("edge"))
        state = checkpointed(
            state.join(edge, "key", "left")
            .withColumn("at", F.coalesce(F.col("edge.upto") - F.col("budget") < F.col("budget") - F.col("edge.before"), F.lit(False)))
            .withColumn("budget", F.col("budget") - F.coalesce(F.col("edge.before"), F.lit(0)))
            .withColumn("prefix", F.coalesce(F.col("edge.bucket"), F.lit(-1)))
            .drop("edge")
        )
    return state.select("key", "source_size", "target", "copies", F.col("prefix").alias("threshold"), "at")


def times(hash_: Column) -> Column:
    """How often a document is taken."""
    return F.col("copies") + ((hash_ < F.col("threshold")) | ((hash_ == F.col("threshold")) & F.col("at"))).cast("long")


def plan(docs: DataFrame, seed: str = "mix", **options) -> tuple[DataFrame, DataFrame]:
    """Sizes of documents, and what to take of each source, with a broadcast hint
    where the sources, counted, are few."""
    rows = checkpointed(sizes(docs, seed))
    aims = checkpointed(targets(rows, **options))
    few = aims.count() <= FEW_SOURCES
    return rows, _few(checkpointed(thresholds(rows, aims, few)), few)


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    rows, sources = plan(docs, seed, **options)
    return rows.join(sources, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("hash"))).alias("taken"))


def apply(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it says, with all its columns."""
    _, sources = plan(docs, seed, **options)
    key, hash_, take, time = (free_name(docs, name) for name in ("key", "hash", "take", "time"))
    known = sources.select(F.struct("copies", "threshold", "at").alias(take), F.col("key").alias(f"{key}_"))
    taken = docs.withColumn(key, source_key()).withColumn(hash_, document_hash(seed)).join(known, F.col(key) == F.col(f"{key}_"))
    below = (F.col(hash_) < F.col(f"{take}.threshold")) | ((F.col(hash_) == F.col(f"{take}.threshold")) & F.col(f"{take}.at"))
    times_ = (F.col(f"{take}.copies") + below.cast("long")).cast("int")
    many = taken.where(times_ > 0).withColumn(time, F.explode(F.sequence(F.lit(1), times_)))
    return many.select(*docs.columns)


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix:' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
by_source AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS most
  FROM by_source),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM weighed),
aims AS (SELECT k, source_size, least(CAST(most AS DOUBLE), (SELECT max(lvl) FROM levels) * w) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM aims),
summed AS (
  SELECT s.doc_id, s.k, s.size, s.h, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
    CAST(sum(s.size) OVER (PARTITION BY s.k ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto,
    CAST(sum(s.size) OVER (PARTITION BY s.k, s.h) AS DOUBLE) AS own
  FROM sized s JOIN budgets b ON s.k = b.k),
marked AS (SELECT *, min(CASE WHEN upto > budget THEN h END) OVER (PARTITION BY k) AS threshold FROM summed)
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN h < coalesce(threshold, -1) OR (h = threshold AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS taken
FROM marked
"""
