"""Joins in which one key may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.plans.storage import checkpointed

#: A key with more rows than this, and than 1 / HEAVY of all, is looked up by broadcast.
ROWS, HEAVY = 8000, 1 << 16


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that rows does not have, in any case."""
    taken = {c.lower() for c in rows.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of table, which has one row a key and says in n how many
    of all total rows have it; those without one are left out.

    Keys with more than their share are HEAVY at most, so they are broadcast and their
    rows stay where they are; the rest is joined by shuffle."""
    values = [c for c in table.columns if c not in (key, "n")]
    if total <= ROWS:
        return rows.join(table.select(key, *values), key)
    table = checkpointed(table)
    heavy = table.where(F.col("n") > max(ROWS, total // HEAVY))
    if heavy.isEmpty():
        return rows.join(table.select(key, *values), key)
    centre = free_name(rows, "centre")
    centres = F.broadcast(heavy.select(F.col(key).alias(centre), F.struct(*values).alias(f"{centre}s")))
    marked = rows.join(centres, F.col(key) == F.col(centre), "left")
    rest = marked.where(F.col(centre).isNull()).drop(centre, f"{centre}s").join(table.select(key, *values), key)
    many = marked.where(F.col(centre).isNotNull()).select(*rows.columns, f"{centre}s.*")
    return rest.select(*rows.columns, *values).union(many)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with m, the least b of each a."""
    return looked_up(edges, edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", total)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of all ends of edges (a, b).

    In each round all greater neighbours of a node hang on its least one, then all
    lesser ones; in a few rounds a star is left of each component. No round deals a
    centre's neighbours to one task."""
    held = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _print(held)
    while before[0]:
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = _with_least(both, 2 * before[0]).where("b > a")
        up = checkpointed(near.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        down = _with_least(up, before[0])
        held = checkpointed(down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.where("b = m").select("a", "b")).distinct())
        now = _print(held)
        if now == before:
            break
        before = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
