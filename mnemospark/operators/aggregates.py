"""Aggregates that need a place in an order: exact quantiles without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Buckets of a group's range of values at each level, and levels at most.
BUCKETS, LEVELS = 4096, 3


def ranked_values(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, ranked): of each group's values in order the one with index floor(q * n), counted from 0 and n at most less one; nulls don't count, and values are finite.

    Values are counted by bucket between the group's bounds; the bucket that holds the wanted index gives narrower
    bounds, and so on until all values within are equal. Each level is one aggregation with partial sums, so a group of
    any size is never sorted. Equal values share a bucket, whatever their number.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    bounds = held.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    bounds = bounds.select("g", "low", "high", F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1).alias("left"))
    for _ in range(LEVELS):
        inside = _inside(held, bounds)
        width = (F.col("high") - F.col("low")) / BUCKETS
        bucket = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BUCKETS - 1))).otherwise(0)
        counts = inside.groupBy("g", "left", bucket.alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        # At most BUCKETS rows a group from here on.
        before = F.sum("m").over(W.partitionBy("g").orderBy("b")) - F.col("m")
        bounds = counts.withColumn("before", before).where("before <= left and left < before + m").select("g", "low", "high", (F.col("left") - F.col("before")).alias("left"))
    # After the levels a bucket holds equal values, or ones that differ in their last bits: those few are sorted.
    same = _inside(held, bounds).groupBy("g", "left", "v").agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("g").orderBy("v")) - F.col("m")
    return same.withColumn("before", before).where("before <= left and left < before + m").select(F.col("g").alias(group), F.col("v").alias("ranked"))


def _inside(held: DataFrame, bounds: DataFrame) -> DataFrame:
    """The values within their group's bounds, with these."""
    by = bounds.withColumnRenamed("g", "h")
    return held.join(by, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop("h")
