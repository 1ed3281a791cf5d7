"""Recall over batches of requests: citations, tiers with a floor, episodes in time windows, the shortcut cascade and graph behaviours."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import retrieval as RE

FLOOR = 0.4
#: Added to the score of an episode in the window.
IN_WINDOW = 1.0


def citations(hits: DataFrame, kind: str, k: int) -> DataFrame:
    """(qid, kind, id, score, snippet): the k best of hits (qid, id, score, snippet), scores from 0 to 1."""
    best = hits.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)
    return best.select("qid", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.round(RE.min_max(F.col("score"), W.partitionBy("qid")), 6).alias("score"), "snippet")


def adaptive(requests: DataFrame, tiers: list[tuple], floor: float = FLOOR, sufficient: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, strategy, escalations, hits, context): tiers in order, up to the first whose best score reaches the floor, else abstain.

    A tier is its name, its citations, and, if only some requests may use it, a condition on their columns; others pass it
    over unmentioned. Where the caller's own condition, on the number of citations so far, does not hold, a tier that
    reached the floor goes on. Citations of all tiers that were tried are merged, the best score of each kept; the context
    joins them by score. escalations says of each tier why it stopped or went on. At most a tier's k citations a request are gathered.
    """
    may = [tier[2] if len(tier) > 2 else F.lit(True) for tier in tiers]
    state = requests.select("qid", F.array(*[F.coalesce(c, F.lit(False)) for c in may]).alias("asked"))
    asked, so_far = lambda i: F.get("asked", F.lit(i)), F.lit(0)
    for i, tier in enumerate(tiers):
        state = state.join(tier[1].groupBy("qid").agg(F.max("score").alias(f"top{i}"), F.count("*").alias(f"n{i}")), "qid", "left")
    stop, said, over, done = F.lit(len(tiers)), [], [], []
    for i in range(len(tiers)):
        so_far = so_far + F.when(asked(i), F.coalesce(f"n{i}", F.lit(0))).otherwise(0)
        over.append(F.col(f"top{i}") >= floor)
        done.append(asked(i) & over[i] & (sufficient(so_far) if sufficient else F.lit(True)))
    for i in reversed(range(len(tiers))):
        stop = F.when(done[i], i).otherwise(stop)
    state = state.withColumn("stop", stop)
    for i, tier in enumerate(tiers):
        why = F.when(F.col(f"top{i}").isNull(), "zero_hits").when(F.col("stop") == i, "tier_complete").when(over[i], "not_sufficient").otherwise("below_floor")
        said.append(F.when((F.col("stop") >= i) & asked(i), F.concat(F.lit(tier[0] + ":"), why)))
    said.append(F.when(F.col("stop") == len(tiers), "abstain:exhausted"))
    strategy = reduce(lambda a, i: F.when(F.col("stop") == i, tiers[i][0]).otherwise(a), range(len(tiers)), F.lit("abstain"))
    state = state.select("qid", "asked", "stop", strategy.alias("strategy"), F.concat_ws(",", *said).alias("escalations"))
    every = reduce(lambda a, b: a.unionByName(b), (tier[1].withColumn("tier", F.lit(i)) for i, tier in enumerate(tiers)))
    tried = every.join(state.select("qid", "asked", "stop"), "qid").where("tier <= stop and asked[tier]")
    merged = tried.groupBy("qid", "kind", "id").agg(F.max(F.struct("score", "snippet")).alias("x")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("x.score")).alias("s"), "kind", "id", "x.snippet"))).alias("c"))
    out = state.join(merged, "qid", "left")
    context = F.coalesce(F.array_join(F.transform("c", lambda x: x["snippet"]), "\n\n"), F.lit(""))
    return out.select("qid", "strategy", "escalations", F.coalesce(F.size("c"), F.lit(0)).alias("hits"), context.alias("context"))


def with_memories(found: DataFrame, cited: DataFrame) -> DataFrame:
    """Episodes (qid, id, …) with the memories (id, memory_id, …) that cite them, a row each; episodes that none cites stay with nulls."""
    return found.join(cited.join(found.select("id").distinct(), "id", "left_semi"), "id", "left")


def precedents(hits: DataFrame, pool: int = 20) -> DataFrame:
    """Of the pool best hits (qid, id, score, kind, text) the decisions, the first of those that say the same; fewer than asked for if others fill the pool."""
    best = hits.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where((F.col("place") <= pool) & (F.col("kind") == "decision"))
    same = F.lower(F.btrim("text"))
    return best.withColumn("again", F.row_number().over(W.partitionBy("qid", same).orderBy("place"))).where("again = 1").drop("again")


def episodes(requests: DataFrame, sessions: DataFrame, scores: DataFrame, k: int, hard: bool = False, least: int = 1) -> DataFrame:
    """(qid, id, score, at, rank): the k best sessions of each request by score, then newest.

    requests: (qid, ns, after, before), the bounds inclusive and null without a window; sessions: (ns, id, at, tagged);
    scores: (qid, id, score). Where a namespace has tagged sessions, only they count. A session in the window gains
    IN_WINDOW; hard keeps only those, unless fewer than least are in it.
    """
    tags = sessions.groupBy("ns").agg(F.max("tagged").alias("any"))
    own = sessions.join(tags, "ns").where("tagged or not any").drop("any", "tagged")
    inside = F.coalesce((F.col("at") >= F.col("after")) & (F.col("at") <= F.col("before")), F.lit(False))
    pairs = own.join(RE.if_small(requests), "ns").select("qid", "id", "at", inside.alias("inside"))
    enough = pairs.groupBy("qid").agg(F.sum(F.col("inside").cast("int")).alias("n")).where(F.col("n") >= least).select("qid", F.lit(True).alias("enough"))
    if hard:
        pairs = pairs.join(enough, "qid", "left").where("inside or enough is null")
    base = F.coalesce("score", F.lit(0.0)) + F.when(F.col("inside"), IN_WINDOW).otherwise(0.0)
    ranked = pairs.join(scores, ["qid", "id"], "left").select("qid", "id", F.round(base, 6).alias("score"), "at")
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.desc("at"), "id"))).where(F.col("rank") <= k)


def shortcut(requests: DataFrame, exact: DataFrame, scored: DataFrame, floor: float = 0.0, k: int = 5) -> DataFrame:
    """(qid, tier, id, reason): the first tier that answers a request: outcome, context, procedure, else work.

    scored: (qid, id, kind, score, reusable, fresh, drifted), scores over the best of their request and kind. The outcome
    is the best that can be reused; the context a fresh observation, first of exact (qid, id, at, fresh), the newest of a
    key, which counts only if itself is fresh, then the best of the scored; the procedure is the best one, advisory
    whatever its environment.
    """
    ranked = scored.withColumn("n", F.row_number().over(W.partitionBy("qid", "kind").orderBy(F.desc("score"), "id"))).where((F.col("n") <= k) & (F.col("score") >= floor))
    newest = exact.groupBy("qid").agg(F.max(F.struct("at", "id", "fresh")).alias("x")).where("x.fresh").select("qid", "x.id")
    tier = lambda df, p, name, reason, n=F.lit(1): df.select("qid", F.struct(F.lit(p).alias("p"), n.alias("n"), F.lit(name).alias("tier"), F.col("id"), reason.alias("reason")).alias("x"))
    found = [
        tier(ranked.where("kind = 'outcome' and reusable"), 1, "outcome", F.lit("match"), F.col("n")),
        tier(newest, 2, "context", F.lit("exact")),
        tier(ranked.where("kind = 'context' and fresh"), 3, "context", F.lit("semantic"), F.col("n")),
        tier(ranked.where("kind = 'procedure'"), 4, "procedure", F.when(F.col("drifted"), "advisory_env_drift").otherwise("advisory"), F.col("n")),
    ]
    best = reduce(lambda a, b: a.unionByName(b), found).groupBy("qid").agg(F.min("x").alias("x"))
    return requests.select("qid").join(best, "qid", "left").select("qid", F.coalesce("x.tier", F.lit("work")).alias("tier"), "x.id", F.coalesce("x.reason", F.lit("no-reuse")).alias("reason"))


def behaved(hits: DataFrame, retracted: str, superseded: str) -> DataFrame:
    """Hits (status, successor) as a graph search shows them, with flagged.

    retracted: hide, flag or surface_both; superseded: hide, prefer_new (gone if their successor is a hit of the same query)
    or surface_both.
    """
    out = hits.withColumn("flagged", (F.col("status") == "retracted") & F.lit(retracted == "flag"))
    if retracted == "hide":
        out = out.where("status <> 'retracted'")
    if superseded == "hide":
        return out.where("status <> 'superseded'")
    if superseded == "prefer_new":
        shown = out.select(F.col("qid").alias("__q"), F.col("id").alias("__s"))
        return out.join(shown, (F.col("qid") == F.col("__q")) & (F.col("successor") == F.col("__s")) & (F.col("status") == "superseded"), "left_anti")
    return out


def packed_order(citations: DataFrame, nodes: DataFrame, most_citations: int = 50, most_nodes: int = 10) -> DataFrame:
    """(qid, place, id, line): what may enter a context: citations (qid, id, score, line) by score, then nodes (qid, id, status, kind, at, line) that have a line, by urgency and newest first."""
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    first = citations.withColumn("place", order).where(F.col("place") <= most_citations).select("qid", "place", F.concat(F.lit("citation:"), "id").alias("id"), "line")
    urgent = F.row_number().over(W.partitionBy("qid").orderBy(urgency(F.col("status"), F.col("kind")), F.desc("at"), "id"))
    second = nodes.where("line is not null").withColumn("place", urgent).where(F.col("place") <= most_nodes)
    return first.unionByName(second.select("qid", (F.col("place") + most_citations).alias("place"), F.concat(F.lit("node:"), "id").alias("id"), "line"))


def urgency(status: Column, kind: Column) -> Column:
    """Lower goes first: finished work last, blockers and decisions as urgent as what is blocked or failed."""
    rank = F.when(status.isin("blocked", "failed"), 0).when(status == "active", 1).when(status == "pending", 2).otherwise(5)
    return F.when(status.isin("done", "superseded", "abandoned"), 9).when(kind.isin("blocker", "decision"), F.least(rank, F.lit(0))).otherwise(rank)
