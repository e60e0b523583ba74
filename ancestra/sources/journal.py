"""The crawl journal: append-only rows of works and citations, and what resumes from them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODES = "id string, title string, abstract string, publication_year int, topic_id string, authors array<string>, referenced_works array<string>, ingest_order long"


def append(works: DataFrame, folder: str) -> None:
    """Add rows of works, whose referenced_works are the citations."""
    works.write.mode("append").json(f"{folder}/nodes")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NODES).json(f"{folder}/nodes")


def visited(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder).select("id").distinct()


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """All citations seen, fetched or not, as often as journalled."""
    return read(spark, folder).select(F.col("id").alias("source"), F.explode("referenced_works").alias("target"))


def to_tables(spark: SparkSession, folder: str) -> None:
    """Parquet tables of the journal: first row of each work, distinct citations."""
    place = F.row_number().over(W.partitionBy("id").orderBy("ingest_order"))
    first = read(spark, folder).withColumn("place", place).where("place = 1").drop("place", "referenced_works")
    first.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edges(spark, folder).distinct().write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def save_state(folder: str, state: dict) -> None:
    """A crawl's place, replaced in one step; the driver's own file."""
    part = os.path.join(folder, "state.json.part")
    with open(part, "w") as f:
        json.dump(state, f)
    os.replace(part, os.path.join(folder, "state.json"))


def load_state(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, "state.json")) as f:
            return json.load(f)
    except FileNotFoundError:
        return None
