"""Journal files as a stream: each batch adds what no batch before it had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ancestra.sources.journal import NODES


def new_citations(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of citations of new journal files, each pair once."""
    rows = spark.readStream.schema(NODES).json(f"{folder}/nodes")
    return rows.select(F.col("id").alias("source"), F.explode("referenced_works").alias("target")).dropDuplicates(["source", "target"])


def merge_into(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a table and stop; the checkpoint remembers which files were read."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")  # a batch that runs again replaces itself

    return new_citations(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
