"""Work records of a bibliographic interface as flat rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import text
from ancestra.plans.storage import checkpointed

PAYLOAD = (
    "id string, title string, display_name string, publication_year int, publication_date string, cited_by_count long, referenced_works array<string>, "
    "abstract_inverted_index map<string,array<int>>, primary_topic struct<id:string>, authorships array<struct<author:struct<display_name:string>>>"
)


def flat(payload: DataFrame) -> DataFrame:
    """One row a work: prefixes stripped, abstract in order, names that are there."""
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return payload.select(
        text.strip_prefix(F.col("id")).alias("id"),
        F.coalesce("title", "display_name").alias("title"),
        text.inverted_to_text(F.col("abstract_inverted_index")).alias("abstract"),
        "publication_year",
        "publication_date",
        "cited_by_count",
        text.strip_prefix(F.col("primary_topic.id")).alias("topic_id"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.transform("referenced_works", lambda r: text.strip_prefix(r)), F.array().cast("array<string>")).alias("referenced_works"),
    )


def condition(*more: Column, topic: str | None = None, start: int | None = None, end: int | None = None) -> Column:
    """All conditions together, those on topic and years where given; they reach the scan."""
    parts = list(more)
    if topic is not None:
        parts.append(F.col("topic_id") == topic)
    if start is not None:
        parts.append(F.col("publication_year") >= start)
    if end is not None:
        parts.append(F.col("publication_year") <= end)
    return functools.reduce(operator.and_, parts, F.lit(True))


def citing(works: DataFrame, work_id: str, **bounds) -> DataFrame:
    return works.where(condition(F.array_contains("referenced_works", work_id), **bounds))


def referenced(works: DataFrame, work_id: str) -> DataFrame:
    ids = works.where(F.col("id") == work_id).select(F.explode("referenced_works").alias("id")).distinct()
    return works.join(ids, "id", "left_semi")


def work(works: DataFrame, work_id: str) -> DataFrame:
    """The record of one id, if there is one."""
    return works.where(F.col("id") == work_id).limit(1)


def chunks(ids: DataFrame, size: int) -> DataFrame:
    """id and chunk: ids in order, so many to a chunk, the last one shorter.

    Ids are numbered by ranges: each partition holds a range, and begins where the
    counts of those before it end."""
    ranged = checkpointed(ids.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))  # a row a partition
    place = F.row_number().over(W.partitionBy("part").orderBy("id")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(starts), "part").select("id", F.floor((F.col("start") + F.col("place")) / size).alias("chunk"))
