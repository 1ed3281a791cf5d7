"""Context assembly: budget packing, transcript reduction and reuse of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(items: Column, budget: int) -> Column:
    """Of an ordered array of struct(id, tokens): the ids taken greedily, skipping what doesn't fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["ids"], x["id"])).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(items, start, step)


def reuse_verdict(expired: Column, same: Column, narrow_same: Column, worth: Column) -> Column:
    """Expired first; an equal environment reuses if that pays; drift outside the declared dimensions is noise."""
    return F.when(expired, "expired").when(same, F.when(worth, "match").otherwise("not_worth")).when(narrow_same, F.when(worth, "reused_noise").otherwise("not_worth")).otherwise("drift")


def best_first(candidates: DataFrame, by: str, order: list[Column], most: int | None = None) -> DataFrame:
    """(by, id, reuse, reason): of each one's candidates (by, id, verdict) the first in order that can be reused.

    If none can, the last that was tried, with its reason. At most that many are tried, if most is given.
    """
    from pyspark.sql import Window as W

    ranked = candidates.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("__n") <= most)
    reuses = F.col("verdict").isin("match", "reused_noise")
    tried = F.struct("__n", "id", "verdict")
    found = ranked.groupBy(by).agg(F.min(F.when(reuses, tried)).alias("hit"), F.max(tried).alias("last"))
    chosen = F.coalesce("hit", "last")
    return found.select(by, chosen["id"].alias("id"), F.col("hit").isNotNull().alias("reuse"), chosen["verdict"].alias("reason"))


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    from pyspark.sql import Window as W

    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
