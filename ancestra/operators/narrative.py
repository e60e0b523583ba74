"""Claims about sources, kept only if a judge finds them in the quoted text.

Everything but the two calls of a language model is relational; a provider is any
function from a table of prompts to a table of answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.functions import text
from ancestra.operators.walks import ranked
from ancestra.plans.storage import checkpointed

UNKNOWN = "not one of the sources"
NO_VERDICT = "no verdict"

Provider = Callable[[DataFrame], DataFrame]


def sources(scores: DataFrame, nodes: DataFrame, top: int = 8) -> DataFrame:
    """origin, id, place, title, year, abstract of ranked works that have an abstract."""
    chosen = ranked(scores, top).select("origin", "id", "place")
    told = nodes.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "abstract")
    return chosen.join(told, "id").where("abstract is not null and abstract <> ''")


def prompts(found: DataFrame, nodes: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """origin and prompt: the target, its abstract, the quoted sources in order, and the ids allowed."""
    body = text.quoted(F.col("id"), F.col("title"), F.col("year"), F.col("abstract"))
    listed = found.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("place", "id", body.alias("body")))).alias("rows"))
    own = nodes.select(F.col("id").alias("origin"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    joined = listed.join(own, "origin")
    parts = [
        F.concat(F.lit("The work traced is "), F.col("origin"), F.lit(', "'), F.col("title"), F.lit('" ('), F.col("year"), F.lit(").")),
        F.concat(F.lit("Its abstract:\n"), text.quoted(F.col("origin"), F.lit(""), F.lit(""), F.col("abstract"))),
        F.concat(F.lit("Works that it depends on, in order:\n"), F.array_join(F.transform("rows", lambda r: r["body"]), "\n\n")),
        F.concat(F.lit("Make one claim a work, with these ids only: "), F.array_join(F.transform("rows", lambda r: r["id"]), ", "), F.lit(".")),
    ]
    prompt = F.concat_ws("\n\n", *parts)
    if rejected is not None:
        failed = rejected.groupBy("origin").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.col("reason")))), "\n").alias("failed"))
        joined = joined.join(failed, "origin", "left")
        prompt = F.concat_ws("\n\n", prompt, F.concat(F.lit("These claims did not hold:\n"), F.col("failed")))
    return joined.select("origin", prompt.alias("prompt"))


def judged(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """origin, claim, supported, reason: the last verdict of each number that names a claim."""
    n = claims.groupBy("origin").agg(F.count("*").alias("n"))
    fit = verdicts.join(n, "origin").where("claim >= 0 and claim < n")
    return fit.groupBy("origin", "claim").agg(F.max_by("supported", "ord").alias("supported"), F.max_by("reason", "ord").alias("reason"))


def verified(claims: DataFrame, found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims (origin, claim, id) with kept and reason; without a verdict none is kept."""
    known = found.select("origin", "id").withColumn("known", F.lit(True))
    joined = claims.join(known, ["origin", "id"], "left").join(verdicts, ["origin", "claim"], "left")
    reason = F.when(F.col("known").isNull(), UNKNOWN).when(F.col("supported").isNull(), NO_VERDICT).when(~F.col("supported"), F.replace(F.coalesce("reason", F.lit("")), F.lit(text.SOURCE_END), F.lit("")))
    return joined.select("origin", "claim", "id", (F.col("known").isNotNull() & F.coalesce("supported", F.lit(False))).alias("kept"), reason.alias("reason"))


def assembled(checked: DataFrame, attempts: int) -> DataFrame:
    """One row an origin: ids kept, how many were rejected, and whether the account is partial."""
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("id"))))
    return checked.groupBy("origin").agg(kept.alias("claims"), F.count_if(~F.col("kept")).alias("rejected"), F.bool_or(~F.col("kept")).alias("partial")).withColumn("attempts", F.lit(attempts))


def narrate(scores: DataFrame, nodes: DataFrame, draft: Provider, judge: Callable[[DataFrame, DataFrame], DataFrame], top: int = 8, attempts: int = 2) -> DataFrame:
    """Draft, verify, and draft again what had rejections, up to so many attempts."""
    found = checkpointed(sources(scores, nodes, top))
    waiting, rejected, done = found, None, None
    for attempt in range(1, attempts + 1):
        claims = checkpointed(draft(prompts(waiting, nodes, rejected)))
        checked = checkpointed(verified(claims, found, judged(judge(claims, found), claims)))
        bad = checked.where("not kept")
        again = bad.select("origin").distinct() if attempt < attempts else bad.select("origin").limit(0)
        ended = assembled(checked.join(again, "origin", "left_anti"), attempt)
        done = ended if done is None else done.union(ended)
        if again.isEmpty():
            break
        waiting, rejected = found.join(again, "origin", "left_semi"), bad.select("origin", "id", "reason")
    return done


def scripted_draft(prompt: DataFrame) -> DataFrame:
    """A provider without a model: one claim for each id that the prompt allows."""
    ids = F.split(F.regexp_extract("prompt", r"these ids only: ([^\n]*)\.", 1), ", ")
    return prompt.select("origin", F.posexplode(ids).alias("claim", "id"))


def scripted_judge(claims: DataFrame, found: DataFrame) -> DataFrame:
    """A judge without a model: a claim holds if its source has some length."""
    texts = found.select("origin", "id", F.length("abstract").alias("size"))
    return claims.join(texts, ["origin", "id"]).select("origin", "claim", (F.col("size") >= 500).alias("supported"), F.lit("the abstract is too short").alias("reason"), F.lit(0).alias("ord"))
