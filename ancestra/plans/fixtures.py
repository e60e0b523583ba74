"""A citation graph drawn from the plain tables by arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years that clean() keeps.
START, END = 1982, 2030


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, title, abstract, year, cited_by, topic, authors, ord."""
    docs = documents(spark, sf_dir)
    last = docs.agg(F.max("doc_id").alias("last"))
    year = F.expr("1980 + (45 * doc_id) div last + CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 0 END").cast("int")
    return docs.crossJoin(F.broadcast(last)).select(  # one row
        F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("n"),
        F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"),
        F.col("text").alias("abstract"),
        year.alias("year"),
        (F.col("n_chars") % 100).alias("cited_by"),
        F.concat(F.lit("T"), F.col("lang")).alias("topic"),
        F.array("source", "lang").alias("authors"),
        F.col("doc_id").alias("ord"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: acyclic, from later documents to earlier ones."""
    spread = documents(spark, sf_dir).where("doc_id > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("j")).where("j <= 2 + doc_id % 5")
    ends = spread.selectExpr("doc_id AS s", "(doc_id * ((doc_id * 31 + j * 37) % 13 + 1)) div 16 AS t").where("s <> t").distinct()
    return ends.select(F.concat(F.lit("W"), F.col("s").cast("string")).alias("source"), F.concat(F.lit("W"), F.col("t").cast("string")).alias("target"))


def _number(column: str) -> Column:
    return F.substring(column, 2, 20).cast("long")


def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citations, and their reverse where the source's number is a multiple of 50."""
    edges = citations(spark, sf_dir)
    back = edges.where(_number("source") % 50 == 0).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.union(back).distinct()


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works with repeated rows and with twins under other punctuation, authors and years."""
    base = works(spark, sf_dir)
    again = base.where("n % 29 = 0").withColumn("title", F.lit("a later copy")).withColumn("ord", F.col("n") + 1_000_000)
    twin = base.where("n % 40 = 3").select(F.concat(F.lit("P"), F.col("n").cast("string")).alias("id"), "n", F.concat(F.lit("¿"), F.col("title"), F.lit("!")).alias("title"), "abstract", (F.col("year") - 1).alias("year"), "cited_by", "topic", F.array(F.concat(F.element_at("authors", 1), F.lit(", Ada 1950-"))).alias("authors"), (F.col("n") + 2_000_000).alias("ord"))
    named = base.withColumn("authors", F.when(F.col("n") % 40 == 3, F.array(F.concat(F.lit("A "), F.element_at("authors", 1)))).otherwise(F.col("authors")))
    return named.unionByName(again).unionByName(twin)


def raw_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cyclic citations with self-loops, dangling ends and repeated rows."""
    edges = cyclic(spark, sf_dir)
    own = works(spark, sf_dir)
    loops = own.where("n % 97 = 0").select(F.col("id").alias("source"), F.col("id").alias("target"))
    dangling = own.where("n % 31 = 0").select(F.col("id").alias("source"), F.concat(F.lit("W"), (F.col("n") + 10_000_000).cast("string")).alias("target"))
    twin = edges.where(_number("target") % 40 == 3).where(_number("source") % 3 == 0).select("source", F.concat(F.lit("P"), F.substring("target", 2, 20)).alias("target"))
    again = edges.where(_number("source") % 29 == 0)
    return edges.union(loops).union(dangling).union(twin).union(again)


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("n % 211 = 5").select("id")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("n % 97 = 1").select("id", F.concat(F.lit("Corrected "), F.col("n").cast("string")).alias("new_title"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("n % 101 = 7").select(F.col("id").alias("dup"), F.concat(F.lit("W"), (F.col("n") - 6).cast("string")).alias("kept"))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one target: the last document."""
    return documents(spark, sf_dir).agg(F.concat(F.lit("W"), F.max("doc_id").cast("string")).alias("origin"))


ORDER_CITATIONS = """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS source, CAST(before AS STRING) AS target FROM (
  SELECT l_orderkey, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber) AS before
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)
WHERE before <> l_orderkey
"""


def order_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large graph: each order cites the order before it of each of its parts."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("lineitem", "orders")}
    return spark.sql(ORDER_CITATIONS.format(**tables))


# The same in SQL for DuckDB.
BASE = """
works AS (
  SELECT 'W' || doc_id AS id, doc_id AS n, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS title, text AS abstract,
    CAST(1980 + (45 * doc_id) // (SELECT max(doc_id) FROM documents) + CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 0 END AS INT) AS year,
    n_chars % 100 AS cited_by, 'T' || lang AS topic, [source, lang] AS authors, doc_id AS ord
  FROM documents),
edges AS (
  SELECT DISTINCT 'W' || s AS source, 'W' || t AS target FROM (
    SELECT doc_id AS s, (doc_id * ((doc_id * 31 + j * 37) % 13 + 1)) // 16 AS t
    FROM documents, range(1, 7) g(j) WHERE doc_id > 0 AND j <= 2 + doc_id % 5) WHERE s <> t),
cyclic AS (
  SELECT source, target FROM edges UNION SELECT target, source FROM edges WHERE CAST(substr(source, 2) AS BIGINT) % 50 = 0),
newest AS (SELECT 'W' || max(doc_id) AS origin FROM documents)
"""

RAW = """
raw_works AS (
  SELECT id, n, title, abstract, year, topic, CASE WHEN n % 40 = 3 THEN ['A ' || authors[1]] ELSE authors END AS authors, ord FROM works
  UNION ALL SELECT id, n, 'a later copy', abstract, year, topic, authors, n + 1000000 FROM works WHERE n % 29 = 0
  UNION ALL SELECT 'P' || n, n, '¿' || title || '!', abstract, year - 1, topic, [authors[1] || ', Ada 1950-'], n + 2000000 FROM works WHERE n % 40 = 3),
raw_edges AS (
  SELECT source, target FROM cyclic
  UNION ALL SELECT id, id FROM works WHERE n % 97 = 0
  UNION ALL SELECT id, 'W' || (n + 10000000) FROM works WHERE n % 31 = 0
  UNION ALL SELECT source, 'P' || substr(target, 2) FROM cyclic WHERE CAST(substr(target, 2) AS BIGINT) % 40 = 3 AND CAST(substr(source, 2) AS BIGINT) % 3 = 0
  UNION ALL SELECT source, target FROM cyclic WHERE CAST(substr(source, 2) AS BIGINT) % 29 = 0)
"""
