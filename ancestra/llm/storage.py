"""The folder that the driver and all executors share, and the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ancestra.operators.joins import free_name
from ancestra.plans.storage import checkpointed, new_folder, shared_folder

__all__ = ["checkpointed", "documents", "free_name", "new_path", "shared_folder"]

new_path = new_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
