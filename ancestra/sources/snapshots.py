"""Dated snapshots of a clean graph: two tables and a record of how they came about."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"\d{4}-\d{2}-\d{2}$")


def _folders(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(n for s in fs.listStatus(path) if _NAME.match(n := s.getPath().getName()))


def write(nodes: DataFrame, edges: DataFrame, report: DataFrame, root: str, date: str) -> str:
    folder = f"{root.rstrip('/')}/{date}"
    for name, table in (("nodes", nodes), ("edges", edges), ("report", report)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def latest(spark: SparkSession, root: str) -> str:
    """The newest snapshot's folder; an error if there is none."""
    found = _folders(spark, root)
    if not found:
        raise FileNotFoundError(f"no snapshot under {root}")
    return f"{root.rstrip('/')}/{found[-1]}"


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def with_recovered(edges: DataFrame, recovered: DataFrame | None) -> DataFrame:
    """Citations of both catalogues as a bag; cleaning drops repeats later."""
    return edges if recovered is None else edges.unionByName(recovered)
