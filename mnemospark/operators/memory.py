"""Bitemporal memories as an append-only operation log and its fold.

Operations have a sequence number; the fold is one aggregation by memory, so any prefix of the log gives the state at
that transaction. Of several closings the last wins; deletes leave the validity as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import pii as PI
from ..functions import text as T

OP_SCHEMA = "seq long, op string, memory_id long, text string, at timestamp_ntz, supersedes array<long>, confidence double"


def dangling(ops: DataFrame) -> DataFrame:
    """Additions that supersede a memory that was never added; they are rejected."""
    adds = ops.where("op = 'add'")
    wanted = adds.select("seq", F.explode("supersedes").alias("target"))
    return wanted.join(adds.select(F.col("memory_id").alias("target")), "target", "left_anti")


def folded(ops: DataFrame, until: int | None = None) -> DataFrame:
    """memory_id, text, status, effective_from, effective_until, confirmations, last_confirmed, confidence."""
    if until is not None:
        ops = ops.where(F.col("seq") <= until)
    ops = ops.join(dangling(ops).select("seq").distinct(), "seq", "left_anti")
    adds = ops.where("op = 'add'").select("memory_id", "text", F.col("at").alias("effective_from"), "confidence", "seq", "supersedes")
    closes = adds.select(F.explode("supersedes").alias("memory_id"), "seq", F.col("effective_from").alias("at"), F.lit("supersede").alias("op"))
    events = ops.where("op in ('retract', 'delete', 'confirm')").select("memory_id", "seq", "at", "op").unionByName(closes)
    last = lambda *kinds: F.max(F.when(F.col("op").isin(*kinds), F.struct("seq", "op", "at")))
    state = events.groupBy("memory_id").agg(
        last("supersede", "retract", "delete").alias("state"), last("supersede", "retract").alias("closed"),
        F.count(F.when(F.col("op") == "confirm", 1)).alias("confirms"), F.max(F.when(F.col("op") == "confirm", F.col("at"))).alias("last_confirmed"),
    )
    status = F.expr("case state.op when 'supersede' then 'superseded' when 'retract' then 'retracted' when 'delete' then 'deleted' else 'active' end")
    until_at = F.when(F.col("closed.op") == "supersede", F.greatest("closed.at", "effective_from")).otherwise(F.col("closed.at"))
    n = 1 + F.coalesce("confirms", F.lit(0))
    # Each confirmation raises the confidence by the count it makes: a fold, as its order matters.
    confidence = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.col("confidence"), lambda c, k: F.greatest(c, T.evolved_confidence(F.col("confidence"), k)))
    return adds.drop("seq", "supersedes").join(state, "memory_id", "left").select(
        "memory_id", "text", status.alias("status"), "effective_from", until_at.alias("effective_until"), n.alias("confirmations"), "last_confirmed", F.round(confidence, 9).alias("confidence")
    )


def purged(memories: DataFrame, before) -> DataFrame:
    """What is left without superseded memories that ended before the cutoff."""
    return memories.where(~((F.col("status") == "superseded") & F.coalesce(F.col("effective_until") < F.lit(before).cast("timestamp_ntz"), F.lit(False))))


def insert_or_confirm(incoming: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """first_id, confirmations by distinct fact: the first of equal facts is inserted, later ones confirm it."""
    w = W.partitionBy(*keys)
    return incoming.withColumn("__n", F.row_number().over(w.orderBy(order))).withColumn("confirmations", F.count("*").over(w)).where("__n = 1").drop("__n")


def tiled(memories: DataFrame, slot: list[str], order: str) -> DataFrame:
    """Chains by slot: each memory ends where the next begins, never before its own start."""
    after = F.lead("effective_from").over(W.partitionBy(*slot).orderBy(order))
    return memories.withColumn("effective_until", F.when(after.isNotNull(), F.greatest(after, F.col("effective_from"))))


#: Texts of a memory that are scrubbed before it is stored.
FIELDS = ("text", "summary", "detail", "action")


def scrubbed_fields(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows with sensitive data of the fields as numbered tokens, and flags: the types found in any of them, in order. Null fields stay null."""
    kept = [c for c in rows.columns if c not in fields]
    found = rows.select(*kept, *[PI.scrub(F.col(f)).alias(f) for f in fields])
    types = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f)["types"], F.array().cast("array<string>")) for f in fields]))))
    return found.select(*kept, *[F.col(f)["text"].alias(f) for f in fields], types.alias("flags"))


def additions(incoming: DataFrame, scope: list[str], known: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """What adding memories does, in the order of memory_id: the incoming columns scrubbed, with flags, op, target, duplicate_of and effective_from.

    A text that its scope has already, in known (memory_id, text, scope) or in an earlier row, makes the row a confirmation
    of the first that has it, unless the row supersedes something; then it is added and names the first. A memory is valid
    from its event_date, else from its time `at`. Scrubbed texts are compared, so facts that differ in sensitive data only
    are one. Of rows with one memory_id and text each is decided alike; null scopes and null texts are values of their own.
    """
    key = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col("text").alias("t"))), 256)
    rows = scrubbed_fields(incoming, fields).withColumn("__key", key)
    every = rows.select("__key", F.lit(1).alias("late"), "memory_id")
    if known is not None:
        every = every.unionByName(known.select(key.alias("__key"), F.lit(0).alias("late"), "memory_id"))
    first = every.groupBy("__key").agg(F.min(F.struct("late", "memory_id")).alias("__first"))
    # As many keys as texts, though their number isn't known before: they are joined where they are, never through the driver.
    joined = rows.join(first.hint("merge"), "__key").drop("__key")
    own = (F.col("__first.late") == 1) & (F.col("__first.memory_id") == F.col("memory_id"))
    add = own | (F.coalesce(F.size("supersedes"), F.lit(0)) > 0)
    return joined.select(
        *[c for c in joined.columns if c not in ("__first", "event_date")], F.when(add, "add").otherwise("confirm").alias("op"), F.when(add, F.col("memory_id")).otherwise(F.col("__first.memory_id")).alias("target"),
        F.when(~own, F.col("__first.memory_id")).alias("duplicate_of"), F.coalesce("event_date", "at").alias("effective_from"),
    )


def committed(candidates: DataFrame, scope: list[str], least: float, known: DataFrame | None = None) -> DataFrame:
    """Candidates (memory_id, text, scope, confidence, source_refs, at) with a reason, an error, duplicate_of and flags.

    Those below the least confidence (or without one) go first, then those without text or source reference; they are
    stored nowhere, so no later candidate duplicates them. What is left is accepted, or duplicates a memory of its scope.
    """
    below = ~F.coalesce(F.col("confidence") >= least, F.lit(False))
    error = F.when(F.coalesce(F.btrim("text"), F.lit("")) == "", "empty text").when(F.coalesce(F.size("source_refs"), F.lit(0)) <= 0, "no source reference")
    judged = candidates.select("*", F.when(below, "below_threshold").when(error.isNotNull(), "validation_error").alias("reason"), F.when(~below, error).alias("error"))
    whole = judged.where("reason is null").withColumn("supersedes", F.array().cast("array<long>")).withColumn("event_date", F.lit(None).cast("timestamp_ntz"))
    stored = additions(whole, scope, known, ("text",)).withColumn("reason", F.when(F.col("op") == "add", "accepted").otherwise("duplicate"))
    refused = judged.where("reason is not null").withColumn("duplicate_of", F.lit(None).cast("long")).withColumn("flags", F.array().cast("array<string>"))
    return stored.select(*refused.columns).unionByName(refused)


def commit_report(decisions: DataFrame, settings: dict) -> DataFrame:
    """One row: counts of candidates by outcome, the types of sensitive data in what was accepted, and a digest of the settings."""
    count = lambda reason: F.count(F.when(F.col("reason") == reason, 1)).alias(reason)
    spelled = json.dumps(settings, sort_keys=True)
    return decisions.agg(
        F.count("*").alias("candidates"), *map(count, ("accepted", "below_threshold", "validation_error", "duplicate")),
        F.array_sort(F.flatten(F.collect_set(F.when(F.col("reason") == "accepted", F.col("flags"))))).alias("flags"),
    ).select("*", F.array_join(F.array_distinct("flags"), ",").alias("pii_flags"), F.sha2(F.lit(spelled), 256).alias("fingerprint")).drop("flags")
