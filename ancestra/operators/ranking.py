"""Scorers side by side: rankings of many targets, and how well they agree with known originators.

Rankings are rows (scorer, origin, id, place); gold is (origin, split, work, ids),
where any of a work's ids counts for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.operators import metrics, temporal, walks
from ancestra.plans.storage import checkpointed

HALF_LIFE = 10.0

#: Baselines by name, each of (lineage, straight lineage, reached, years).
BASELINES: dict[str, Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "in_degree": lambda lineage, straight, reached, years: walks.in_degree(lineage, reached),
    "gateway": lambda lineage, straight, reached, years: walks.gateway(straight, reached.select("origin").distinct()),
    "path_weight": lambda lineage, straight, reached, years: walks.path_weight(straight, reached),
    "time_decayed_pagerank": lambda lineage, straight, reached, years: walks.aged(walks.pagerank(lineage, reached), years, HALF_LIFE),
}


def _named(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("scorer"), *t.columns) for name, t in tables.items()))


def baselines(lineage: DataFrame, reached: DataFrame, years: DataFrame, straight: DataFrame | None = None) -> DataFrame:
    """scorer, origin, id, score of all baselines on one lineage, which is made acyclic once."""
    straight = checkpointed(walks.acyclic(lineage, years)) if straight is None else straight
    return _named({name: score(lineage, straight, reached, years).select("origin", "id", "score") for name, score in BASELINES.items()})


def scores(edges: DataFrame, years: DataFrame, origins: DataFrame, learned: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of targets by all scorers, and what each target reaches.

    Baselines and the even flow come always. learned gives more flows by name: from the
    acyclic lineage to its citations with a column weight."""
    reached = checkpointed(walks.reach(edges, origins))
    lineage = checkpointed(walks.ancestry(edges, reached))
    straight = checkpointed(walks.acyclic(lineage, years))
    flows = {"uniform_flow": walks.flow(straight, reached, years)} | {name: walks.flow(weigh(straight), reached, years) for name, weigh in (learned or {}).items()}
    return baselines(lineage, reached, years, straight).unionByName(_named(flows)), reached


def rankings(scored: DataFrame, top: int = 10) -> DataFrame:
    """scorer, origin, id, place: the top works by each scorer."""
    keyed = scored.withColumn("both", F.struct("scorer", "origin"))
    best = walks.ranked(keyed.select(F.col("both").alias("origin"), "id", "score"), top)
    return best.select("origin.scorer", "origin.origin", "id", "place")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """scorer, origin, overlap: the share of each left ranking that the right one has, null if it is empty."""
    hit = right.select("scorer", "origin", "id").withColumn("hit", F.lit(1))
    joined = left.join(hit, ["scorer", "origin", "id"], "left")
    return joined.groupBy("scorer", "origin").agg((F.count("hit") / F.count("*")).alias("overlap"))


def seed_overlap(runs: list[DataFrame]) -> DataFrame:
    """origin, seed_overlap: mean agreement of all pairs of runs (origin, id) of one scorer."""
    if len(runs) < 2:
        return runs[0].select("origin").distinct().withColumn("seed_overlap", F.lit(None).cast("double"))
    told = reduce(DataFrame.union, (r.select("origin", "id", F.lit(k).alias("run")) for k, r in enumerate(runs)))
    later = told.select("origin", "id", F.col("run").alias("later"))
    met = told.join(later, ["origin", "id"]).where("run < later").groupBy("origin", "run", "later").agg(F.count("*").alias("both"))
    size = told.groupBy("origin", "run").agg(F.count("*").alias("n"))
    others = size.select("origin", F.col("run").alias("later"), F.col("n").alias("m"))
    pairs = size.join(others, "origin").where("run < later").join(met, ["origin", "run", "later"], "left")
    return pairs.groupBy("origin").agg(F.avg(F.coalesce("both", F.lit(0)) / F.col("n")).alias("seed_overlap"))


def assessed(ranked: DataFrame, stressed: DataFrame, reached: DataFrame, gold: DataFrame, seeds: DataFrame, top: int = 10) -> DataFrame:
    """One row a target of gold and scorer: originators, reachable, found, recall, ndcg,
    dropout_overlap and seed_overlap.

    Recall and nDCG are over the works that the target reaches, null if it reaches none;
    found counts all. Targets that reached does not have are left out. stressed: the
    rankings on a thinned graph; seeds: seed_overlap by origin."""
    known = gold.join(reached.select("origin").distinct(), "origin", "left_semi")
    ids = known.select("origin", "work", F.explode("ids").alias("id"))
    held = ids.join(reached.select("origin", "id"), ["origin", "id"], "left_semi").select("origin", "work").distinct()
    findable = known.join(held, ["origin", "work"], "left_semi")
    counts = known.groupBy("origin", "split").agg(F.count("*").alias("originators")).join(findable.groupBy("origin").agg(F.count("*").alias("reachable")), "origin", "left")
    each = counts.select("origin", "split", "originators", F.coalesce("reachable", F.lit(0)).alias("reachable")).join(ranked.select("scorer").distinct(), how="cross")  # a row a scorer
    best = ranked.where(F.col("place") <= top)
    found = best.join(ids, ["origin", "id"]).groupBy("scorer", "origin").agg(F.count_distinct("work").alias("found"))
    pairs = best.select("scorer").distinct().join(findable, how="cross")  # a row a scorer
    both = F.to_json(F.struct("scorer", "origin")).alias("origin")
    judged = metrics.recall_ndcg(best.select(both, "id", "place"), pairs.select(both, "work", "ids"), top)
    told = F.from_json("origin", "scorer string, origin string")
    judged = judged.select(told["scorer"].alias("scorer"), told["origin"].alias("origin"), "recall", "ndcg")
    kept = agreement(best, stressed.where(F.col("place") <= top)).withColumnRenamed("overlap", "dropout_overlap")
    out = each
    for part in (judged, kept, found):
        out = out.join(part, ["scorer", "origin"], "left")
    return out.join(seeds, "origin", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def split_summary(targets: DataFrame) -> DataFrame:
    """Means over a split's targets by scorer, nulls left out; originators, reachable and found are summed."""
    totals = [F.sum(c).alias(c) for c in ("originators", "reachable", "found")]
    means = [F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in ("recall", "ndcg", "dropout_overlap", "seed_overlap")]
    return targets.groupBy("split", "scorer").agg(F.count("*").alias("targets"), *totals, *means)


def assess(edges: DataFrame, years: DataFrame, gold: DataFrame, weighers: list[Callable[[DataFrame], DataFrame]] | None = None, top: int = 10, dropout: float = 0.1, seed: str = "0") -> DataFrame:
    """assessed for the targets of gold on edges and on edges thinned by dropout.

    weighers: learned flows of one scorer, one a training seed; the first is ranked
    beside the baselines, all of them tell how much seeds matter."""
    weighers = weighers or []
    ends = edges.select(F.col("source").alias("origin")).union(edges.select("target")).distinct()
    origins = gold.select("origin").distinct().join(ends, "origin", "left_semi")
    learned = {"learned": weighers[0]} if weighers else None
    scored, reached = scores(edges, years, origins, learned)
    thin = scores(temporal.thinned(edges, dropout, seed), years, origins, learned)[0]
    ranked = checkpointed(rankings(scored, top))
    runs = [ranked.where("scorer = 'learned'")] if weighers else [ranked.where("scorer = 'uniform_flow'")]
    for weigh in weighers[1:]:
        runs.append(rankings(scores(edges, years, origins, {"learned": weigh})[0].where("scorer = 'learned'"), top))
    return assessed(ranked, checkpointed(rankings(thin, top)), reached, gold, seed_overlap([r.select("origin", "id") for r in runs]), top)
