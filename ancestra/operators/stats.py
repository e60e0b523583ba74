"""Counts and summaries of a citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.operators.walks import components


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree and out_degree of all works, zeros included."""
    ins = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("i"))
    outs = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("o"))
    joined = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left")
    return joined.select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def histogram(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def most_cited(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The top works by citations in the graph, ties by id, with their attributes."""
    best = degrees(nodes, edges).orderBy(F.col("in_degree").desc(), "id").limit(top)
    return best.join(nodes.select("id", "title", "year"), "id").select("id", "title", "year", "in_degree")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; safe for an empty graph."""
    d = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.avg("in_degree").alias("mean_in"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"), F.count_if(F.col("in_degree") + F.col("out_degree") == 0).alias("isolated"))
    e = edges.agg(F.count("*").alias("edges"))
    sizes = components(edges, nodes.select("id")).groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    y = nodes.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("abstract").isNull() | (F.col("abstract") == "")).alias("no_abstract"))
    one = d.crossJoin(e).crossJoin(sizes).crossJoin(y)  # one row each
    return one.withColumn("density", F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))).withColumn("largest_share", F.try_divide(F.col("largest"), F.col("nodes"))).drop("largest")
