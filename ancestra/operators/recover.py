"""Citations that a second catalogue records, matched to works by id or title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions.text import title_key
from ancestra.operators import joins
from ancestra.plans.storage import checkpointed

#: Ids from here on are this catalogue's own and mean nothing to the other.
OWN_IDS = 4_000_000_000

SLACK = 1


def foreign_id(work_id: Column) -> Column:
    """The number after W if the other catalogue knows it, else null."""
    number = F.regexp_extract(work_id, "^W?([0-9]{1,18})$", 1)
    value = F.nullif(number, F.lit("")).cast("long")
    return F.when(value < OWN_IDS, value)


def recovered(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """source, target: matches of references (source, ref_title, ref_year, ref_id).

    An id that is held wins; else a title that names exactly one work within a year
    (or without a year on a side). A match with the source itself is no citation."""
    named = references.where("ref_id is not null").join(nodes.select(F.col("id").alias("found")), F.concat(F.lit("W"), F.col("ref_id")) == F.col("found"), "left")
    columns = ("source", "ref_title", "ref_year", "found")  # references without an id would all be one key
    by_id = named.select(*columns).union(references.where("ref_id is null").withColumn("found", F.lit(None).cast("string")).select(*columns))
    titles = nodes.select(F.col("id").alias("candidate"), F.col("year"), title_key(F.col("title")).alias("t")).where("t <> ''")
    rest = by_id.where("found is null").withColumn("t", title_key(F.col("ref_title"))).where("t <> ''").select("source", "t", "ref_year")
    ends = checkpointed(titles.groupBy("t", "year").agg(F.min("candidate").alias("low"), F.max("candidate").alias("high")).where("low is not null"))
    # what a title and year name does not hang on the source: it is told once
    asked = checkpointed(rest.groupBy("t", "ref_year").agg(F.count("*").alias("n")))
    near = [F.col("ref_year") + k for k in range(-SLACK, SLACK + 1)] + [F.lit(None).cast(dict(asked.dtypes)["ref_year"])]
    dated = asked.where("ref_year is not null").withColumn("year", F.explode(F.array(*near)))
    met = dated.join(ends, dated["t"].eqNullSafe(ends["t"]) & dated["year"].eqNullSafe(ends["year"])).select(dated["t"], "ref_year", "n", "low", "high")
    undated = asked.where("ref_year is null").join(ends, "t").select("t", "ref_year", "n", "low", "high")
    told = met.union(undated).groupBy("t", "ref_year", "n").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
    both_keys = F.struct("t", "ref_year")
    table = told.select(both_keys.alias("key"), F.col("low").alias("target"), "n")
    one = joins.looked_up(rest.select("source", both_keys.alias("key")), table, "key", asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    both = by_id.where("found is not null").select("source", F.col("found").alias("target")).union(one.select("source", "target"))
    return both.where("source <> target").distinct()


def new_only(found: DataFrame, edges: DataFrame) -> DataFrame:
    return found.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")
