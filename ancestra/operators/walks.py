"""Reachability, cycles, and walks from many targets at once.

Edges are (source, target) rows: source cites target. Targets are rows of one
column, ``origin``; every result carries it, so one plan serves a batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ancestra.operators import joins
from ancestra.plans.storage import checkpointed


#: A frontier of no more rows is broadcast, so that a round reads the citations and deals none out.
FRONTIER = 1 << 17

#: Citations of one origin that one task may search for cycles, or move mass along.
SEARCHED = 1 << 21


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FRONTIER else df


def reach(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, id and depth (least number of citations) of each work reached, the origin at 0."""
    step = checkpointed(edges.select("source", "target").distinct())
    frontier = checkpointed(origins.select("origin", F.col("origin").alias("id")).distinct())
    seen, depth, rows = frontier.withColumn("depth", F.lit(0)), 0, frontier.count()
    while True:
        depth += 1
        met = step.join(_small(frontier, rows), F.col("id") == F.col("source")).select("origin", F.col("target").alias("id")).distinct()
        frontier = checkpointed(met.join(seen.select("origin", "id"), ["origin", "id"], "left_anti"))
        rows = frontier.count()
        if not rows:
            return seen
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))


def ancestry(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """origin, source, target: the citations among the works each origin reaches."""
    ends = reached.select("origin", "id")
    left = edges.select("source", "target").distinct().join(ends.withColumnRenamed("id", "source"), "source")
    return left.join(ends.withColumnRenamed("id", "target"), ["origin", "target"], "left_semi").select("origin", "source", "target")


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """origin, a, b: b is reached by one citation or more from a, one of starts (origin, a); edges carry origin."""
    step = checkpointed(edges.select(F.col("origin").alias("o"), F.col("source").alias("b1"), F.col("target").alias("b2")).distinct())
    held = new = checkpointed(step.select(F.col("o").alias("origin"), F.col("b1").alias("a"), F.col("b2").alias("b")).join(starts.select("origin", "a"), ["origin", "a"], "left_semi"))
    while rows := new.count():
        met = step.join(_small(new, rows), (F.col("origin") == F.col("o")) & (F.col("b") == F.col("b1"))).select("origin", "a", F.col("b2").alias("b")).distinct()
        new = checkpointed(met.join(held, ["origin", "a", "b"], "left_anti"))
        held = held.union(new)
    return held


def _searched(group: pd.DataFrame) -> pd.DataFrame:
    """origin, id, knot of one origin's citations, by a depth-first search."""
    codes, ids = pd.factorize(pd.concat([group.a, group.b]), sort=True)
    n, half = len(ids), len(group)
    order = codes[:half].argsort(kind="stable")
    start = [0, *pd.Series(codes[:half]).value_counts().reindex(range(n), fill_value=0).cumsum()]
    to = codes[half:][order].tolist()
    at, low, open_, path, knots, count = [0] * n, [0] * n, [False] * n, [], [-1] * n, 0
    for root in range(n):
        todo = [] if at[root] else [(root, start[root])]
        while todo:
            v, k = todo.pop()
            if not at[v]:
                count += 1
                at[v] = low[v] = count
                open_[v] = True
                path.append(v)
            elif k > start[v] and open_[to[k - 1]]:  # back from the citation before
                low[v] = min(low[v], low[to[k - 1]])
            while k < start[v + 1] and at[to[k]]:
                if open_[to[k]]:
                    low[v] = min(low[v], at[to[k]])
                k += 1
            if k < start[v + 1]:
                todo += [(v, k + 1), (to[k], start[to[k]])]
            elif low[v] == at[v]:
                own = []
                while not own or own[-1] != v:
                    own.append(path.pop())
                    open_[own[-1]] = False
                if len(own) > 1:
                    least = min(own)
                    for x in own:
                        knots[x] = least
    found = [v for v in range(n) if knots[v] >= 0]
    names = ids.to_numpy(dtype=object)
    return pd.DataFrame({"origin": [group.origin.iloc[0]] * len(found), "id": [names[v] for v in found], "knot": [names[knots[v]] for v in found]}, dtype=object)


def _coloured(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Some components of citations (origin, a, b), one at least, and the citations without them.

    Each work takes the greatest colour (hash and id) that reaches it. Works of one colour
    that reach the work it comes from are its component."""
    ends = left.select("origin", F.col("a").alias("id")).union(left.select("origin", "b")).distinct()
    colours = new = checkpointed(ends.withColumn("colour", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("of"))))
    while rows := new.count():
        told = left.join(_small(new.select("origin", F.col("id").alias("a"), "colour"), rows), ["origin", "a"]).groupBy("origin", F.col("b").alias("id")).agg(F.max("colour").alias("told"))
        met = checkpointed(colours.join(told, ["origin", "id"], "left"))
        better = F.coalesce(F.col("told") > F.col("colour"), F.lit(False))
        new = checkpointed(met.where(better).select("origin", "id", F.col("told").alias("colour")))
        colours = met.select("origin", "id", F.when(better, F.col("told")).otherwise(F.col("colour")).alias("colour"))
    colours = checkpointed(colours.select("origin", "id", F.col("colour.of").alias("of")))
    a, b = (colours.select("origin", F.col("id").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab")
    alike = checkpointed(left.join(a, ["origin", "a"]).join(b, ["origin", "b"]).where("of_a = of_b").select("origin", "a", "b"))
    held = new = checkpointed(colours.where("id = of"))
    while rows := new.count():
        met = alike.join(_small(new.select("origin", F.col("id").alias("b"), "of"), rows), ["origin", "b"]).select("origin", F.col("a").alias("id"), "of").distinct()
        new = checkpointed(met.join(held, ["origin", "id"], "left_anti"))
        held = held.union(new)
    held = checkpointed(held)
    for end in "ab":
        left = left.join(held.select("origin", F.col("id").alias(end)), ["origin", end], "left_anti")
    return held, checkpointed(left.select("origin", "a", "b"))


def knots(lineage: DataFrame) -> DataFrame:
    """origin, id, knot: works on a cycle with others, and the least id of their strongly connected component.

    Works that cite or are cited by none that is left are on no cycle and go first. What
    is left of an origin is searched in one task if it has SEARCHED citations or fewer;
    else components are told by rounds of joins until it has."""
    left = checkpointed(lineage.select("origin", F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct())
    found, before = [], None
    while True:
        per = left.groupBy("origin").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        most, total = per[0] or 0, per[1] or 0
        if most <= SEARCHED:
            break
        if before is None or total < 0.9 * before:
            citing, cited = left.select("origin", F.col("a").alias("id")), left.select("origin", F.col("b").alias("id"))
            both = checkpointed(citing.distinct().join(cited.distinct(), ["origin", "id"]))
            for end in "ab":
                left = left.join(both.withColumnRenamed("id", end), ["origin", end], "left_semi")
            left, before = checkpointed(left.select("origin", "a", "b")), total
        else:
            some, left = _coloured(left)
            found.append(some)
            before = None
    out = left.groupBy("origin").applyInPandas(_searched, "origin string, id string, knot string")
    for some in found:
        many = some.groupBy("origin", "of").agg(F.min("id").alias("knot"), F.count("*").alias("n")).where("n > 1")
        out = out.union(some.join(many, ["origin", "of"]).select("origin", "id", "knot"))
    return checkpointed(out)


def acyclic(lineage: DataFrame, years: DataFrame) -> DataFrame:
    """A lineage without cycles: of each strongly connected component the works are
    ordered from new to old (undated last), by citations within it, then by id, and
    citations against that order go. years: id, year."""
    tangled = knots(lineage)
    source = tangled.select("origin", F.col("id").alias("source"), F.col("knot").alias("ks"))
    target = tangled.select("origin", F.col("id").alias("target"), F.col("knot").alias("kt"))
    marked = checkpointed(lineage.join(source, ["origin", "source"], "left").join(target, ["origin", "target"], "left"))
    degree = marked.where("ks = kt").groupBy("origin", F.col("target").alias("id")).agg(F.count("*").alias("degree"))
    place = F.struct((-F.coalesce("year", F.lit(0))).alias("age"), F.coalesce("degree", F.lit(0)).alias("degree"), F.col("id").alias("last"))
    ranked = checkpointed(tangled.join(years, "id", "left").join(degree, ["origin", "id"], "left").select("origin", "id", place.alias("place")))
    ps = ranked.select("origin", F.col("id").alias("source"), F.col("place").alias("ps"))
    pt = ranked.select("origin", F.col("id").alias("target"), F.col("place").alias("pt"))
    placed = marked.join(ps, ["origin", "source"], "left").join(pt, ["origin", "target"], "left")
    return placed.where("not coalesce(ks = kt and ps > pt, false)").select("origin", "source", "target")


def _moved(group: pd.DataFrame, least: float, most: int) -> pd.DataFrame:
    """propagate for the edges of one origin."""
    origin = group.origin.iloc[0]
    codes, ids = pd.factorize(pd.concat([pd.Series([origin]), group.source, group.target]))
    source, target, w = codes[1 : len(group) + 1], codes[len(group) + 1 :], group.w.to_numpy()
    now, total, met = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
    now[0], there = 1.0, np.arange(len(ids)) == 0
    for _ in range(most):
        along = there[source]
        if not along.any():
            break
        now = np.bincount(target, now[source] * w, len(ids))
        there = np.bincount(target, along, len(ids)) > 0
        total, met = total + now, met | there
        if now.sum() <= least:
            break
    return pd.DataFrame({"origin": origin, "id": ids[met], "mass": total[met]})


def propagate(weighted: DataFrame, origins: DataFrame, least: float = 0.0, most: int = 1 << 10) -> DataFrame:
    """origin, id, mass: all mass that flows from each origin along weighted edges
    (origin, source, target, w), the sum over all walks of their weights' product.

    On an acyclic graph it ends by itself; elsewhere when no origin has more than least
    in motion, or after so many rounds. Where no origin has more than SEARCHED edges a
    task moves an origin's mass, else each round is a join."""
    weighted = checkpointed(weighted.join(origins.select("origin").distinct(), "origin", "left_semi").select("origin", "source", "target", "w"))
    if (weighted.groupBy("origin").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= SEARCHED:

        def moved_by(group: pd.DataFrame) -> pd.DataFrame:
            return _moved(group, least, most)

        return checkpointed(weighted.groupBy("origin").applyInPandas(moved_by, "origin string, id string, mass double"))
    step = checkpointed(weighted.select(F.col("origin").alias("o"), "source", "target", "w"))
    now = checkpointed(origins.select("origin", F.col("origin").alias("id"), F.lit(1.0).alias("mass")))
    moved, rows, moving = [], now.count(), None
    for _ in range(most):
        met = step.join(_small(now, rows), (F.col("origin") == F.col("o")) & (F.col("id") == F.col("source")))
        now = checkpointed(met.groupBy("origin", F.col("target").alias("id")).agg(F.sum(F.col("mass") * F.col("w")).alias("mass")))
        moved.append(now)
        rows, moving = now.groupBy("origin").agg(F.count("*").alias("n"), F.sum("mass").alias("moving")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("moving")).first()
        if moving is None or moving <= least:
            break
    return checkpointed(reduce(DataFrame.union, moved).groupBy("origin", "id").agg(F.sum("mass").alias("mass")))


def _with_all(total: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    joined = reached.where("depth > 0").select("origin", "id").join(total, ["origin", "id"], "left")
    return joined.select("origin", "id", F.coalesce("mass", F.lit(0.0)).alias(name))


def path_weight(lineage: DataFrame, reached: DataFrame, decay: float = 0.5) -> DataFrame:
    """Sum over all paths of decay to their length; zero for works cut off."""
    return _with_all(propagate(lineage.withColumn("w", F.lit(decay)), reached.select("origin").distinct()), reached, "score")


def flow(lineage: DataFrame, reached: DataFrame, years: DataFrame, damping: float = 0.85, half_life: float = 10.0) -> DataFrame:
    """Each work passes its damped mass on in proportion to edge weights (column weight,
    one for all if absent), then scores decay with age."""
    if "weight" not in lineage.columns:
        lineage = lineage.withColumn("weight", F.lit(1.0))
    whole = F.sum("weight").over(W.partitionBy("origin", "source"))
    weighted = lineage.withColumn("whole", whole).where("whole > 0").withColumn("w", F.col("weight") / F.col("whole") * damping)
    return aged(_with_all(propagate(weighted, reached.select("origin").distinct()), reached, "score"), years, half_life)


def aged(scores: DataFrame, years: DataFrame, half_life: float) -> DataFrame:
    """Scores halved for each half-life between the origin's year and the work's."""
    own = years.select(F.col("id").alias("origin"), F.col("year").alias("origin_year"))
    joined = scores.join(years.select("id", "year"), "id", "left").join(own, "origin", "left")
    gap = F.coalesce(F.col("origin_year") - F.col("year"), F.lit(0))
    return joined.select("origin", "id", (F.col("score") * F.pow(F.lit(0.5), gap / F.lit(half_life))).alias("score"))


def in_degree(lineage: DataFrame, reached: DataFrame) -> DataFrame:
    n = lineage.groupBy("origin", F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return reached.where("depth > 0").select("origin", "id").join(n, ["origin", "id"], "left").select("origin", "id", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def _shared(left: Column, right: Column) -> Column:
    """The first places of two arrays up to where they differ."""
    n = F.least(F.size(left), F.size(right))
    differ = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at(left, k) != F.element_at(right, k))
    return F.slice(left, 1, F.coalesce(F.get(differ, F.lit(0)) - 1, n))


def gateway(lineage: DataFrame, origins: DataFrame) -> DataFrame:
    """How many other works an acyclic lineage loses with each work reached in it.

    A work is lost with those that are on all paths to it. These are a path themselves,
    which begins as the paths of all works that cite it begin alike, so as the least and
    the greatest of them do. A work is told its path once all that cite it have told theirs."""
    own = origins.select("origin").distinct()
    reached = closure(lineage, own.withColumn("a", F.col("origin"))).select("origin", F.col("b").alias("id")).where("id <> origin").union(own.withColumn("id", F.col("origin")))
    edges = lineage.select("origin", "source", "target").distinct().join(checkpointed(reached).withColumnRenamed("id", "source"), ["origin", "source"], "left_semi")
    needed = edges.groupBy("origin", "target").agg(F.count("*").alias("needed"))
    step = checkpointed(edges.join(needed, ["origin", "target"]).select(F.col("origin").alias("o"), "source", "target", "needed"))
    new = checkpointed(own.select("origin", F.col("origin").alias("id"), F.array("origin").alias("path")))
    waiting, paths, rows = None, None, new.count()
    while rows:
        told = step.join(_small(new, rows), (F.col("origin") == F.col("o")) & (F.col("id") == F.col("source")))
        told = told.select("origin", "target", "needed", F.col("path").alias("low"), F.col("path").alias("high"), F.lit(1).cast("long").alias("n"))
        told = told if waiting is None else told.union(waiting)
        state = checkpointed(told.groupBy("origin", "target", "needed").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
        waiting = state.where("n < needed")
        path = F.concat(_shared(F.col("low"), F.col("high")), F.array("target"))
        new = checkpointed(state.where("n = needed").select("origin", F.col("target").alias("id"), path.alias("path")))
        paths = new if paths is None else paths.union(new)
        rows = new.count()
    # a work's own path has it last
    lost = paths.select("origin", F.explode("path").alias("id")).groupBy("origin", "id").agg(F.count("*").alias("n"))
    return lost.where("id <> origin").select("origin", "id", (F.col("n") - 1).cast("double").alias("score"))


def pagerank(lineage: DataFrame, reached: DataFrame, alpha: float = 0.85, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """Personalised PageRank: teleports and works that cite nothing return to the origin.

    All that returns starts anew from the origin, so ranks are the mass of all damped
    walks from it, scaled to one. The walks are followed until less than tolerance
    of an origin's mass is in motion, which on a lineage takes about as many rounds as
    it is deep, and not as many as the teleports need to settle."""
    nodes = reached.select("origin", "id")
    degree = lineage.groupBy("origin", "source").agg(F.count("*").alias("degree"))
    weighted = lineage.join(degree, ["origin", "source"]).withColumn("w", F.lit(alpha) / F.col("degree"))
    moved = propagate(weighted, nodes.select("origin").distinct(), tolerance, most)
    mass = nodes.join(moved, ["origin", "id"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + (F.col("id") == F.col("origin")).cast("int"))
    whole = mass.groupBy("origin").agg(F.sum("mass").alias("whole"))
    return mass.where("id <> origin").join(whole, "origin").select("origin", "id", (F.col("mass") / F.col("whole")).alias("score"))


def ranked(scores: DataFrame, top: int = 10) -> DataFrame:
    """The top works of each origin: score down, then id."""
    order = W.partitionBy("origin").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of the left top works of each origin that the right has; zero if there are none."""
    hit = right.select("origin", "id").distinct().withColumn("hit", F.lit(1))
    joined = left.select("origin", "id").join(hit, ["origin", "id"], "left")
    return joined.groupBy("origin").agg((F.count("hit") / F.count("*")).alias("overlap"))


def skeleton(lineage: DataFrame, shown: DataFrame) -> DataFrame:
    """Paths among shown works that no third shown work lies on, and whether each is a citation."""
    keep = shown.select("origin", "id")
    paths = closure(lineage, keep.withColumnRenamed("id", "a")).join(keep.withColumnRenamed("id", "b"), ["origin", "b"], "left_semi")
    paths = checkpointed(paths.where("a <> b").select("origin", "a", "b"))
    through = paths.select("origin", "a", F.col("b").alias("c")).join(paths.select("origin", F.col("a").alias("c"), "b"), ["origin", "c"]).select("origin", "a", "b")
    direct = lineage.select("origin", F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("direct")).distinct()
    return paths.join(through, ["origin", "a", "b"], "left_anti").join(direct, ["origin", "a", "b"], "left").select("origin", F.col("a").alias("citing"), F.col("b").alias("cited"), F.coalesce("direct", F.lit(False)).alias("direct"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and label (least id of its weakly connected component) of all nodes."""
    roots = joins.components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("label"))
