"""Splits in time, negative samples and features without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import draws
from ancestra.plans.storage import checkpointed

ATTEMPTS = 16


def dated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the years of both ends."""
    s = nodes.select(F.col("id").alias("source"), F.col("year").alias("source_year"))
    t = nodes.select(F.col("id").alias("target"), F.col("year").alias("target_year"))
    return edges.join(s, "source", "left").join(t, "target", "left").select("source", "target", "source_year", "target_year")


def _running(edges: DataFrame) -> DataFrame:
    """year, n, upto (citations up to and with it) and total, of dated citations; one row a year."""
    by_year = edges.where("source_year is not null").groupBy(F.col("source_year").alias("year")).agg(F.count("*").alias("n"))
    return by_year.select("year", "n", F.sum("n").over(W.orderBy("year")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("total"))


def cut_points(edges: DataFrame, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """train_until and val_until: last years of the first two splits, by share of citations."""
    years = _running(edges)

    def index(share: float) -> Column:
        return F.greatest((F.col("total") * F.lit(share)).cast("int") - 1, F.lit(0))

    first = years.agg(F.min(F.when(F.col("upto") > index(1 - val - test), F.col("year"))).alias("train"), F.min(F.when(F.col("upto") > index(1 - test), F.col("year"))).alias("val"), F.max("year").alias("last"))
    crossed = years.select("year").crossJoin(F.broadcast(first))  # one row
    step = crossed.agg(F.max(F.when(F.col("year") < F.col("last"), F.col("year"))).alias("before_last"), *(F.first(c).alias(c) for c in ("train", "val", "last")))
    until = F.when((F.lit(test) > 0) & (F.col("val") == F.col("last")), F.coalesce("before_last", "val")).otherwise(F.col("val"))
    moved = years.select("year").crossJoin(F.broadcast(step.select("train", until.alias("val"))))  # one row
    ended = moved.agg(F.first("train").alias("train"), F.first("val").alias("val_until"), F.max(F.when(F.col("year") < F.col("val"), F.col("year"))).alias("earlier"))
    train = F.when((F.lit(val) > 0) & (F.col("train") >= F.col("val_until")), F.coalesce("earlier", "train")).otherwise(F.col("train"))
    return ended.select(train.alias("train_until"), "val_until")


def split(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """edges with their split; undated ones are in none but always pass messages."""
    year = F.col("source_year")
    name = F.when(year.isNull(), "undated").when(year <= F.col("train_until"), "train").when(year <= F.col("val_until"), "val").otherwise("test")
    return edges.crossJoin(F.broadcast(cuts)).select("source", "target", "source_year", "target_year", name.alias("split"))  # one row


def features(nodes: DataFrame, past: DataFrame) -> DataFrame:
    """Scaled year, dated flag and log counts of each work, over past citations alone."""
    span = nodes.agg(F.min("year").alias("low"), F.greatest(F.max("year") - F.min("year"), F.lit(1)).alias("span"))
    ins = past.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("i"))
    outs = past.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("o"))
    joined = nodes.join(ins, "id", "left").join(outs, "id", "left").crossJoin(F.broadcast(span))  # one row
    return joined.select(
        "id",
        F.coalesce((F.col("year") - F.col("low")) / F.col("span"), F.lit(0.0)).alias("year_scaled"),
        F.col("year").isNotNull().cast("int").alias("dated"),
        F.log1p(F.coalesce("i", F.lit(0))).alias("log_in"),
        F.log1p(F.coalesce("o", F.lit(0))).alias("log_out"),
        F.log1p(F.coalesce(F.size("authors"), F.lit(0))).alias("log_authors"),
    )


def negatives(positives: DataFrame, nodes: DataFrame, existing: DataFrame, seed: str = "0", per: int = 1, year_matched: bool = False, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """source, cited, candidate number and target: citations that could have been made and were not.

    Draws come from hashes; of ATTEMPTS draws the first that is neither the source
    nor a recorded citation counts. Works are ordered by (year, id): a year's works
    have places from ``low`` to below ``high``, found by year alone.

    A draw is a place, and a source's citations are few: their places are at hand where
    the draws are made, so only draws that count leave the task, one a candidate. sources and targets, with
    such a column, are joined where that deals no draws out."""
    spark = positives.sparkSession
    by_year = nodes.where("year is not null").groupBy("year").agg(F.count("*").alias("n")).select("year", "n", F.sum("n").over(W.orderBy("year")).alias("high"))
    by_year = checkpointed(by_year)  # a row a year
    place = F.row_number().over(W.partitionBy("year").orderBy("id")) - 1
    placed = nodes.where("year is not null").select("id", "year", place.alias("k"))
    starts = by_year.select("year", (F.col("high") - F.col("n")).alias("start"))
    numbered = checkpointed(placed.join(F.broadcast(starts), "year").select((F.col("start") + F.col("k")).alias("p"), F.col("id").alias("target")))
    own = positives.select("source", F.col("target").alias("cited"), F.col("target_year" if year_matched else "source_year").alias("year"))
    bounds = by_year.select("year", F.when(F.lit(year_matched), F.col("high") - F.col("n")).otherwise(0).alias("low"), "high")
    if not year_matched:  # years without works of their own still have all earlier ones
        limits = own.select(F.col("year").alias("limit_year")).distinct().join(F.broadcast(bounds), F.col("year") <= F.col("limit_year"))
        bounds = limits.groupBy(F.col("limit_year").alias("year")).agg(F.lit(0).cast("long").alias("low"), F.max("high").alias("high"))
    own = own.join(F.broadcast(bounds), "year").where("high > low").groupBy("source", "cited").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    barred = existing.select("source", "target").union(own.select("source", F.col("source").alias("target"))).join(own.select("source"), "source", "left_semi")
    taken = barred.join(numbered, "target").groupBy("source").agg(F.collect_set("p").alias("taken"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows here are many after the draws
    held = own.repartition(parts, "source").join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))

    if sources is not None:
        held = held.join(sources, "source")
    told = [c for c in held.columns if c not in ("source", "cited", "low", "high", "taken")]

    def draw(candidate: Column, attempt: Column) -> Column:
        return F.col("low") + draws.integer(F.col("high") - F.col("low"), F.lit(seed), F.col("source"), F.col("cited"), candidate, attempt)

    def first_free(candidate: Column) -> Column:
        def tried(found: Column, attempt: Column) -> Column:
            return F.when(found.isNotNull(), found).otherwise(F.get(F.filter(F.array(draw(candidate, attempt)), lambda p: ~F.array_contains("taken", p)), F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("bigint"), tried)

    drawn = held.select("source", "cited", *told, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(per)), first_free)).alias("k", "p")).where("p is not null")
    if targets is not None:
        numbered = numbered.join(targets, "target")
    found = [c for c in numbered.columns if c not in ("p", "target")]
    return drawn.join(numbered, "p").select("source", "cited", (F.col("k") + 1).alias("candidate"), "target", *told, *found)


def labelled(positives: DataFrame, negatives_: DataFrame) -> DataFrame:
    """Both as one table with label 1 and 0."""
    return positives.select("source", "target", F.lit(1).alias("label")).unionByName(negatives_.select("source", "target", F.lit(0).alias("label")))


def horizons(edges: DataFrame, cuts: int, window: float = 0.1) -> DataFrame:
    """Distinct years that end views, each a window of citations earlier."""
    years = _running(edges)
    wanted = years.select("year", "upto", "total", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("k"))
    index = (F.col("total") * (1 - F.col("k") * F.lit(window))).cast("int") - 1
    index = F.when(index < 0, index + F.col("total")).otherwise(index)
    return wanted.where(F.col("upto") > index).groupBy("k").agg(F.min("year").alias("horizon")).groupBy("horizon").agg(F.min("k").alias("k"))


def view(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """horizon, source, target: citations whose works are all undated or within the horizon."""
    s, t, h = F.col("source_year"), F.col("target_year"), F.col("horizon")
    return edges.join(F.broadcast(ends), (s.isNull() | (s <= h)) & (t.isNull() | (t <= h))).select("horizon", "source", "target")  # a row a cut


def cold_start(positives: DataFrame, messages: DataFrame, share: float, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Positives of a hashed share of citing works, and the messages that touch none of them."""
    held = positives.select("source").distinct().where(draws.uniform(F.lit(seed), F.col("source")) < share)
    left = messages.join(held, "source", "left_anti").join(held.withColumnRenamed("source", "target"), "target", "left_anti")
    return positives.join(held, "source", "left_semi"), left.select("source", "target")


def thinned(edges: DataFrame, share: float, seed: str = "0") -> DataFrame:
    """edges without a hashed share of them."""
    return edges.where(draws.uniform(F.lit(seed), F.col("source"), F.col("target")) >= share)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select("target", "source")).distinct()
