"""Rows as a client shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions.text import byline
from ancestra.operators import walks

#: The drawing's width, margins, the gap for undated works, and rows.
WIDTH, LEFT, RIGHT, UNKNOWN_GAP, TOP, ROW = 720, 56, 24, 40, 36, 30


def timeline(shown: DataFrame) -> DataFrame:
    """x, y and r of each work of each origin (place 0: the origin; id, place, year, score)."""
    all_ = W.partitionBy("origin")
    first, last = F.min("year").over(all_), F.max("year").over(all_)
    start = LEFT + F.when(F.count_if(F.col("year").isNull()).over(all_) > 0, UNKNOWN_GAP).otherwise(0)
    top = F.max(F.when(F.col("place") > 0, F.col("score"))).over(all_)
    spread = F.when(last > first, last - first).otherwise(1)
    x = F.when(F.col("year").isNull(), F.lit(float(LEFT))).otherwise(start + (F.col("year") - first) / spread * (WIDTH - RIGHT - start))
    r = F.when(F.col("place") == 0, 9.0).otherwise(4 + 6 * F.sqrt(F.col("score") / F.when(top > 0, top).otherwise(1.0)))
    return shown.select("origin", "id", "place", x.alias("x"), (TOP + F.col("place") * ROW).alias("y"), r.alias("r"))


def ticks(shown: DataFrame) -> DataFrame:
    """Years on the axis of each origin, about seven at most."""
    ends = shown.groupBy("origin").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    step = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / 6)).cast("int")
    from_ = (F.ceil(F.col("a") / step) * step).cast("int")
    return ends.where(from_ <= F.col("b")).select("origin", F.explode(F.sequence(from_, F.col("b"), step)).alias("year"))


def upstream(links: DataFrame, focus: DataFrame) -> DataFrame:
    """origin, id of all shown works from which the focus (one id an origin) is reached, itself included."""
    turned = links.select(F.concat_ws("\x00", "origin", "cited").alias("source"), F.concat_ws("\x00", "origin", "citing").alias("target"))
    start = focus.select(F.concat_ws("\x00", "origin", "id").alias("origin"))
    both = walks.reach(turned, start).select(F.split("id", "\x00").alias("p"))
    return both.select(F.col("p")[0].alias("origin"), F.col("p")[1].alias("id"))


def client_rows(nodes: DataFrame) -> DataFrame:
    """Works with empty titles as null, whole years, and never-null authors."""
    return nodes.select("id", F.nullif("title", F.lit("")).alias("title"), F.col("year").cast("int").alias("year"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), byline(F.coalesce("authors", F.array().cast("array<string>")), F.col("year")).alias("byline"))


def lineage_payload(scores: DataFrame, nodes: DataFrame, links: DataFrame, baselines: dict[str, DataFrame], top: int = 10) -> DataFrame:
    """One nested row an origin: its works in order, the links, and overlaps with baselines."""
    best = walks.ranked(scores, top)
    works = best.join(nodes.select("id", "title", "year"), "id", "left").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "year", F.round("score", 6).alias("score")))).alias("originators"))
    shown = links.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("citing", "cited", "direct"))).alias("links"))
    out = works.join(shown, "origin", "left")
    for name, other in baselines.items():
        out = out.join(walks.overlap(best, walks.ranked(other, top)).withColumnRenamed("overlap", f"overlap_{name}"), "origin", "left")
    return out
