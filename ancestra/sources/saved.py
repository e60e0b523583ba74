"""Datasets and models in the folders of any store that Spark writes."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ancestra.operators.models import LinkPredictor


def save_dataset(folder: str, nodes: DataFrame, pairs: DataFrame, messages: DataFrame, report: DataFrame) -> None:
    """Features, labelled pairs (parted by split), message citations, and the record of the split."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    pairs.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/pairs")
    messages.write.mode("overwrite").parquet(f"{folder}/messages")
    report.write.mode("overwrite").parquet(f"{folder}/report")


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "pairs", "messages", "report"))


def save_model(spark: SparkSession, model: LinkPredictor, folder: str, **facts) -> None:
    """Weights, a row each, and facts on the training (settings, metrics) as JSON."""
    rows = [(k, list(map(int, w.shape)), [float(x) for x in w.ravel()]) for k, w in enumerate(model.weights)]
    spark.createDataFrame(rows, "k int, shape array<int>, w array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/weights")
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/facts")


def load_model(spark: SparkSession, folder: str) -> tuple[LinkPredictor, dict]:
    rows = spark.read.parquet(f"{folder}/weights").orderBy("k").collect()  # a row a layer's weight
    model = LinkPredictor()
    model.weights = [np.array(r.w).reshape(r.shape) for r in rows]
    return model, json.loads(spark.read.parquet(f"{folder}/facts").first().facts)
