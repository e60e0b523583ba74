"""Snowball expansion of seeds through citations, one join a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.plans.storage import checkpointed


def backward(works: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """id, hop of works fetched up to so many hops; only dated works in range are expanded."""
    fetched = checkpointed(works.select("id", "year").join(seeds.select("id").distinct(), "id", "left_semi").withColumn("hop", F.lit(0)))
    last = fetched
    for hop in range(1, hops + 1):
        grown = last.where(F.col("year").isNotNull())
        if start is not None:
            grown = grown.where(F.col("year") >= start)
        if end is not None:
            grown = grown.where(F.col("year") <= end)
        cited = edges.join(grown.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        new = works.select("id", "year").join(cited, "id", "left_semi").join(fetched.select("id"), "id", "left_anti")
        last = checkpointed(new.withColumn("hop", F.lit(hop)))
        fetched = fetched.union(last)
    return fetched.select("id", "hop")


def forward(works: DataFrame, edges: DataFrame, fetched: DataFrame, hops: int, topic: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """id, hop of citers in topic and range not fetched before; each hop starts from all citers of the last."""
    allowed = works.select("id", "year", "topic")
    for column, low, high in (("year", start, end), ("topic", topic, topic)):
        if low is not None:
            allowed = allowed.where(F.col(column) >= low)
        if high is not None:
            allowed = allowed.where(F.col(column) <= high)
    frontier, out, seen = fetched.select("id"), None, fetched.select("id")
    for hop in range(1, hops + 1):
        citing = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct().join(allowed.select("id"), "id", "left_semi")
        frontier = checkpointed(citing)
        new = checkpointed(frontier.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(new.select("id"))
        out = new if out is None else out.union(new)
    return out if out is not None else fetched.limit(0)


def fill(edges: DataFrame, fetched: DataFrame, least: int) -> DataFrame:
    """id, n of works not fetched that at least so many journalled citations name."""
    journalled = edges.join(fetched.select(F.col("id").alias("source")), "source", "left_semi")
    missing = journalled.join(fetched.select(F.col("id").alias("target")), "target", "left_anti")
    return missing.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def budgeted(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Exactly the first so many rows in an order that is total."""
    return rows.orderBy(*order).limit(most)


def unseen(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """id and ord: the first of each id, in order, of those not seen."""
    return ids.groupBy("id").agg(F.min("ord").alias("ord")).join(seen.select("id"), "id", "left_anti")


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def snowball(works: DataFrame, edges: DataFrame, seeds: DataFrame, folder: str, *, hops: int, forward_hops: int = 0, least: int = 0, topic: str | None = None, start: int | None = None, end: int | None = None, most: int | None = None) -> DataFrame:
    """phase, hop and id of all that a crawl fetches: citations of the seeds hop by hop,
    then works in topic and range that cite them, then what at least so many fetched
    works cite. Each hop is a table of folder, so a crawl that stopped goes on with the
    first hop that is not there; a hop that the budget cut is made again.

    most: fetched works in all, exactly; a hop's works come in the order of their ids."""
    spark = works.sparkSession
    known = works.select("id", "year", *(["topic"] if topic is not None else []))
    fits = F.col("year").isNotNull()
    if start is not None:
        fits = fits & (F.col("year") >= start)
    if end is not None:
        fits = fits & (F.col("year") <= end)
    seen: DataFrame | None = None
    total = 0

    def fetched(phase: str, hop: int, wanted: DataFrame) -> DataFrame:
        """The new works of a hop, from its table or made now."""
        nonlocal seen, total
        place = f"{folder.rstrip('/')}/{phase}-{hop}"
        done = _written(spark, place)
        if done:
            done = spark.read.parquet(place).where("cut").isEmpty()
        if not done:
            new = known.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "year")
            new = new if seen is None else new.join(seen.select("id"), "id", "left_anti")
            cut = F.lit(False)
            if most is not None:
                new = checkpointed(budgeted(new, most - total, "id"))
                cut = F.lit(new.count() == most - total)
            new.withColumn("cut", cut).write.mode("overwrite").parquet(place)
        out = spark.read.parquet(place).select(F.lit(phase).alias("phase"), F.lit(hop).alias("hop"), "id", "year")
        total += out.count()
        seen = out if seen is None else seen.union(out)
        return out

    def full() -> bool:
        return most is not None and total >= most

    last = fetched("backward", 0, seeds)
    for hop in range(1, hops + 1):
        if full():
            break
        grown = last.where(fits).select(F.col("id").alias("source"))
        last = fetched("backward", hop, edges.join(grown, "source", "left_semi").select(F.col("target").alias("id")))
    allowed = known.where(fits if start is not None or end is not None else F.lit(True))
    if topic is not None:
        allowed = allowed.where(F.col("topic") == topic)
    frontier = seeds.select("id").distinct()
    for hop in range(1, forward_hops + 1):
        if full():
            break
        citing = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        frontier = checkpointed(citing.join(allowed.select("id"), "id", "left_semi"))
        fetched("forward", hop, frontier)
    if least and not full():
        fetched("fill", 1, fill(edges, seen, least))
    return seen.select("phase", "hop", "id")
