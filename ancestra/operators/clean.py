"""From raw works and citations to a consistent graph. The order of the steps is part of their meaning.

Works have id, title, abstract, year, authors and ord (order of ingest) besides
others that are kept; citations have source and target.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.functions import text
from ancestra.operators.walks import components
from ancestra.plans.storage import checkpointed

VERSION_GAP = 2
SLACK = 1


def first_of_each(nodes: DataFrame) -> DataFrame:
    """The first row of each id in the order of ingest."""
    place = F.row_number().over(W.partitionBy("id").orderBy("ord"))
    return nodes.withColumn("place", place).where("place = 1").drop("place")


def excluded(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_anti")


def retitled(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles from a table (id, new_title); the abstract of the wrong record goes."""
    joined = nodes.join(titles, "id", "left")
    wrong = F.col("new_title").isNotNull()
    return joined.withColumn("title", F.coalesce("new_title", "title")).withColumn("abstract", F.when(~wrong, F.col("abstract"))).drop("new_title")


def renamed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("authors", F.transform("authors", text.display_name))


def missing(column: Column) -> Column:
    return column.isNull() | (column == "")


def folded(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold records into those they duplicate (pairs: dup, kept), citations and all.

    Pairs count only if both ids are held, and do not chain. A kept record without an
    abstract takes the first that its duplicates have."""
    held = nodes.select("id")
    live = pairs.join(held.withColumnRenamed("id", "dup"), "dup", "left_semi").join(held.withColumnRenamed("id", "kept"), "kept", "left_semi").select("dup", "kept")
    moved = edges
    for end in ("source", "target"):
        moved = moved.join(live.select(F.col("dup").alias(end), F.col("kept").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    spare = nodes.where(~missing(F.col("abstract"))).join(live, F.col("id") == F.col("dup")).groupBy("kept").agg(F.min_by("abstract", "ord").alias("spare"))
    rest = nodes.join(live.select(F.col("dup").alias("id")), "id", "left_anti").join(spare.withColumnRenamed("kept", "id"), "id", "left")
    return rest.withColumn("abstract", F.when(missing(F.col("abstract")) & F.col("spare").isNotNull(), F.col("spare")).otherwise(F.col("abstract"))).drop("spare"), moved.select("source", "target")


def redated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Works dated more than a year after their earliest citer take its year."""
    citer = nodes.select(F.col("id").alias("source"), F.col("year").alias("citer_year"))
    earliest = edges.join(citer, "source").groupBy(F.col("target").alias("id")).agg(F.min("citer_year").alias("earliest"))
    joined = nodes.join(earliest, "id", "left")
    late = F.col("year") > F.col("earliest") + SLACK
    return joined.withColumn("year", F.when(late, F.col("earliest")).otherwise(F.col("year"))).drop("earliest")


def versions(nodes: DataFrame, edges: DataFrame, ascii_only: bool = False) -> DataFrame:
    """dup and kept: records of one title and first author close in year, folded into the most cited."""
    cited = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("citers"))
    keyed = redated(nodes, edges).join(cited, "id", "left").select("id", "year", text.title_key(F.col("title")).alias("t"), text.first_author_key(F.col("authors"), ascii_only).alias("a"), F.coalesce("citers", F.lit(0)).alias("citers"))
    order = W.partitionBy("t", "a").orderBy(F.col("citers").desc(), "id")
    first = keyed.where("t <> '' and a <> ''").select("id", "year", F.first("id").over(order).alias("kept"), F.first("year").over(order).alias("kept_year"))
    return first.where(f"id <> kept and abs(year - kept_year) <= {VERSION_GAP}").select(F.col("id").alias("dup"), "kept")


def in_range(nodes: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Works dated within the bounds; undated ones only if there are none."""
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col("year") >= start)
    if end is not None:
        kept = kept & (F.col("year") <= end)
    return nodes.where(kept)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "target"])


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of the largest weakly connected component; of equal ones that with the least id."""
    labels = components(edges, nodes.select("id"))
    best = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(1)
    return labels.join(best.select("label"), "label", "left_semi").select("id")


def _narrow(nodes: DataFrame) -> DataFrame:
    """nodes with titles as keys, and in place of each abstract where it stands."""
    at = F.when(~missing(F.col("abstract")), F.concat_ws("|", "id", F.col("ord").cast("string")))
    return nodes.withColumn("title", text.title_key(F.col("title"))).withColumn("abstract", at)


def _with_texts(narrow: DataFrame, nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """narrow with its texts: corrected titles, or its own, and the abstracts that it names."""
    texts = nodes.select("id", "ord", F.col("title").alias("own"), F.col("abstract").alias("told")).dropDuplicates(["id", "ord"])
    titled = narrow.join(texts.select("id", "ord", "own"), ["id", "ord"]).join(titles, "id", "left")
    bodies = texts.select(F.concat_ws("|", "id", F.col("ord").cast("string")).alias("abstract"), "told").where(~missing(F.col("told")))
    whole = titled.join(bodies, "abstract", "left").withColumn("title", F.coalesce("new_title", "own")).withColumn("abstract", F.col("told"))
    return whole.select(*narrow.columns)


def clean(nodes: DataFrame, edges: DataFrame, *, exclude: DataFrame, titles: DataFrame, merge: DataFrame, start: int | None = None, end: int | None = None, largest_only: bool = True, ascii_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean works, clean citations, and a one-row report of what each step took.

    The steps run on keys and years; titles and abstracts are joined once, at the end.
    Rows of one id must differ in ord."""
    unique = checkpointed(first_of_each(_narrow(nodes)))
    left = excluded(unique, exclude)
    held = checkpointed(renamed(retitled(left, titles)))
    works, cites = folded(held, edges, merge)
    works, cites = checkpointed(works), checkpointed(cites)
    works, cites = folded(works, cites, versions(works, cites, ascii_only))
    works, cites = checkpointed(works), checkpointed(cites)
    ranged = in_range(works, start, end)
    single = checkpointed(distinct_edges(cites))
    straight = without_loops(single)
    joined = checkpointed(without_dangling(straight, ranged))
    dated = checkpointed(redated(ranged, joined))
    final, ends = dated, joined
    if largest_only:
        keep = checkpointed(largest_component(dated, joined))
        final, ends = dated.join(keep, "id", "left_semi"), without_dangling(joined, keep)
    before = left.select("id", F.posexplode("authors").alias("k", "old"))
    after = held.select("id", F.posexplode("authors").alias("k", "new"))
    tables = {
        "raw_nodes": nodes,
        "unique": unique,
        "retitled_nodes": left.join(titles, "id", "left_semi"),
        "renamed_authors": before.join(after, ["id", "k"]).where("old <> new"),
        "held": held,
        "works": works,
        "ranged": ranged,
        "raw_edges": edges,
        "single": single,
        "straight": straight,
        "joined": joined,
        "redated_nodes": dated.select("id", F.col("year").alias("new")).join(ranged.select("id", "year"), "id").where("new <> year"),
        "final": final,
        "ends": ends,
    }
    counted = functools.reduce(DataFrame.union, (t.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, t in tables.items()))
    n = counted.groupBy().pivot("name", list(tables)).agg(F.first("n"))  # one row
    c = F.col
    report = n.select(
        "raw_nodes",
        "raw_edges",
        (c("raw_nodes") - c("unique")).alias("duplicate_nodes"),
        "retitled_nodes",
        "renamed_authors",
        (c("unique") - c("held")).alias("excluded_nodes"),
        (c("held") - c("works")).alias("merged_nodes"),
        (c("works") - c("ranged")).alias("out_of_range_nodes"),
        (c("raw_edges") - c("single")).alias("duplicate_edges"),
        (c("single") - c("straight")).alias("self_loops"),
        (c("straight") - c("joined")).alias("dangling_edges"),
        "redated_nodes",
        *([(c("ranged") - c("final")).alias("disconnected_nodes")] if largest_only else []),
        c("final").alias("nodes"),
        c("ends").alias("edges"),
    )
    return _with_texts(final, nodes, titles), ends, report
